import json
import os
import random

import pytest

from ledgerlens.sources import files, formats, frames, rlog


def make_log(spark, n, first=1, seed=1):
    rng = random.Random(seed)
    rows = [(i, i // 100 + 1, rng.choice([0, 0, 0, 1, 2]), bytearray(rng.randbytes(12)), bytearray(rng.randbytes(rng.randint(1, 50)))) for i in range(first, first + n)]
    return spark.createDataFrame(rows, "log_index bigint, term bigint, entry_type int, request_id binary, data binary"), rows


def same(df, rows):
    got = sorted((r.log_index, r.term, r.entry_type, bytes(r.request_id), bytes(r.data)) for r in df.collect())
    return got == [(a, b, c, bytes(d), bytes(e)) for a, b, c, d, e in rows]


def test_segment_round_trip(spark, tmp_path):
    log, rows = make_log(spark, 1000)
    rlog.write_log(log, str(tmp_path), capacity=128, meta={"software": "x"})
    assert os.path.exists(tmp_path / "00000/00/00/00000000000001.rlog")
    assert same(rlog.read_log(spark, str(tmp_path)), rows)
    assert same(spark.read.format("rlog").load(str(tmp_path)), rows)
    assert same(rlog.read_log(spark, str(tmp_path), 300, 420), rows[299:420])
    info = rlog.inspect_segments(spark, str(tmp_path)).orderBy("segment_first_index").collect()
    assert [r.segment_first_index for r in info] == [1] + list(range(128, 1001, 128))
    assert info[0].capacity == 127 and info[0].entry_count == 127 and info[1].capacity == 128
    assert sum(r.entry_count for r in info) == 1000 and info[-1].next_index == 1001 and info[0].meta == {"software": "x"}
    assert rlog.list_segments(spark, str(tmp_path)).count() == len(info)


def test_pushdown_prunes_segments(spark, tmp_path):
    log, rows = make_log(spark, 500)
    rlog.write_log(log, str(tmp_path), capacity=64)
    got = spark.read.format("rlog").load(str(tmp_path)).filter("log_index > 100 and log_index <= 150")
    assert got.rdd.getNumPartitions() == 2 and same(got, rows[100:150])
    slim = spark.read.format("rlog").option("payload", "false").load(str(tmp_path))
    assert slim.filter("data is not null").count() == 0


def test_reads_touch_only_what_they_ask_for():
    class Counted(bytes):
        read = 0

        def __getitem__(self, k):
            out = bytes.__getitem__(self, k)
            Counted.read += len(out) if isinstance(k, slice) else 1
            return out

    entries = [formats.build_entry(None, 0, 7, bytes([i]) * 1000) for i in range(100)]
    raw = Counted(formats.build_segment(1, entries, 128))
    info = formats.parse_segment(raw)
    Counted.read = 0
    got = list(formats.segment_entries(raw, info, 40, 42))
    assert [(i, at, n, e) for i, at, n, e in got] == [(i, 1020 * (i - 1), 1020, entries[i - 1]) for i in (40, 41, 42)] and Counted.read == 3060
    Counted.read = 0
    assert [e for *_, e in formats.segment_entries(raw, info, most=20)] == [e[:20] for e in entries] and Counted.read == 2000
    assert sum(b.num_rows for b in rlog._batches(raw, 1, 90, 200, False)) == 11


def test_gaps_are_refused(spark, tmp_path):
    log, _ = make_log(spark, 20)
    with pytest.raises(Exception, match="dense"):
        rlog.write_log(log.filter("log_index <> 7"), str(tmp_path), capacity=64)
    assert rlog.read_log(spark, str(tmp_path)).count() == 0


def test_torn_offsets_end_a_segment():
    entries = [formats.build_entry(None, 0, 1, bytes([i])) for i in range(5)]
    raw = bytearray(formats.build_segment(1, entries, 16))
    raw[24 + 4 * 3 : 24 + 4 * 4] = bytes(4)
    assert len(formats.parse_segment(bytes(raw))["ends"]) == 3
    raw[24 + 4 : 24 + 8] = (1).to_bytes(4, "little")
    with pytest.raises(formats.FormatError):
        formats.parse_segment(bytes(raw))
    for bad in (b"RLOG" + bytes(20), b"nope"):
        with pytest.raises(formats.FormatError):
            formats.parse_segment(bad + bytes(40))
    with pytest.raises(formats.FormatError):
        formats.build_segment(1, [b""], 16)
    assert formats.segment_capacity(1, 16384) == 16383 and formats.segment_capacity(0x123456, 16384) == 16384 - 0x123456 % 16384
    assert formats.segment_index("a/00001/ff/ff/00001fffffff02.rlog") == 0x1FFFFFFF02


def test_stream_follows_the_log(spark, tmp_path):
    from ledgerlens.streaming import feed

    log, rows = make_log(spark, 300)
    rlog.write_log(log.filter("log_index <= 200"), str(tmp_path / "log"), capacity=64)
    got = []
    write = lambda df, n: got.append(sorted(r.log_index for r in df.collect()))
    feed.drain(feed.tail_log(spark, str(tmp_path / "log"), start=5), write, str(tmp_path / "check"))
    assert sum(got, []) == list(range(5, 201))
    rlog.write_log(log.filter("log_index >= 192"), str(tmp_path / "log"), capacity=64, first=192)
    feed.drain(feed.tail_log(spark, str(tmp_path / "log"), start=5), write, str(tmp_path / "check"))
    assert sum(got, []) == list(range(5, 301))


def test_snapshots(spark, tmp_path):
    data = random.Random(4).randbytes(1999)
    p = str(tmp_path / "snap")
    files.write_snapshot(p, 42, 100, b"old")
    files.write_snapshot(p, 42, 100, data, {"created": "now"}, history=p + "-1")
    meta, chunks = files.read_snapshots(spark, p, chunk=500)
    m = meta.first()
    assert (m.log_index, m.log_term, m.data_size, m.meta) == (42, 100, 1999, {"created": "now"})
    assert b"".join(bytes(r.chunk) for r in chunks.orderBy("byte_offset").collect()) == data
    files.write_snapshot(str(tmp_path / "empty"), 1, 1, b"")
    assert [bytes(r.chunk) for r in files.read_snapshots(spark, str(tmp_path / "empty"))[1].collect()] == [b""]
    assert formats.parse_snapshot(formats.build_snapshot(1, 2, b"abc"))["data_offset"] == 44
    with pytest.raises(formats.FormatError):
        formats.parse_snapshot(formats.build_snapshot(1, 2, b"abc") + b"x")
    kinds = {os.path.basename(r.path): r.kind for r in files.file_kinds(spark, str(tmp_path)).collect()}
    assert kinds["snap"] == "snapshot"


def test_state_files(spark, tmp_path):
    p = str(tmp_path / "state")
    state = {"foo": 1, "bar": "baz", "baz": None}
    for c in ({"foo": 2}, {"baz": [1, 2, 3]}, {"foo": 42, "foe": "fee"}, {"bar": None}):
        state = files.append_state(p, c, state)
    assert state == {"foo": 42, "bar": None, "baz": [1, 2, 3]}
    with open(p, "ab") as f:
        f.write(b"\x81\xa3fo")
    changes = files.read_state(spark, p)
    got = {r.field: json.loads(r.value) for r in files.fold_state(changes, list(state)).collect()}
    assert got == state and changes.first().torn
    with open(p, "rb") as f:
        values, torn = formats.state_changes(f.read())
    assert torn and formats.fold_state({"foo": 1, "bar": "baz", "baz": None}, values) == state
    state = files.append_state(p, {"foo": 7}, state, rotate_bytes=1, history=p + "-old")
    with open(p, "rb") as f:
        assert formats.state_changes(f.read()) == ([state], False)


def test_history_and_config(spark, tmp_path):
    names = [f"snap-2024-01-01-0000{i:02d}-{n}" for i in range(40) for n in ("z", "10")] + ["snap", "other"]
    gone = {r.name for r in files.history_to_remove(spark.createDataFrame([(n,) for n in names], "name string"), 60).collect()}
    assert gone == {f"snap-2024-01-01-0000{i:02d}-{n}" for i in range(10) for n in ("z", "10")}
    (tmp_path / "a.json").write_text('{"raft": {"x": 1}, "other.cfg": {"y": {"z": 2}}}')
    (tmp_path / "a.toml").write_text("[raft]\nx = 1\n")
    assert files.read_config(str(tmp_path / "a.json"), "other.cfg.y") == {"z": 2}
    assert files.read_config(str(tmp_path / "a.toml"), "raft") == {"x": 1}
    with pytest.raises(KeyError):
        files.read_config(str(tmp_path / "a.json"), "nope")
    with pytest.raises(ValueError):
        files.read_config(str(tmp_path / "a.ini"))


def test_frames():
    s = frames.FrameSchema(("string", "int", "bool", "uint"))
    assert s.decode(s.encode(["foo", -5, True, 7])) == ["foo", -5, True, 7]
    with pytest.raises(ValueError):
        s.encode(["foo"])
    with pytest.raises(TypeError):
        frames.FrameSchema(("nope",))
    with pytest.raises(ValueError):
        frames.FrameSchema(("uint",)).encode([None])
    x = frames.FrameSchema(("nuint", "object"), required=1, extra=True)
    assert x.decode(x.encode([None, {"a": [1]}, b"more"])) == [None, {"a": [1]}, b"more"]
    for ask, answer in frames.MESSAGES.values():
        for m in (ask, answer):
            values = [{"buffer": b"x", "string": "p", "bool": False, "object": {"k": 1}}.get(k, 9) for k in m.kinds]
            assert m.decode(m.encode(values)) == values


def test_overlapping():
    assert rlog.overlapping([1, 64, 128], 70, 100) == [64]
    assert rlog.overlapping([1, 64, 128], 10, 500) == [1, 64, 128]
    assert rlog.overlapping([64, 128], 1, 63) == []
    assert rlog.overlapping([64, 128], 1, 70) == [64]


def test_dumps(spark, tmp_path):
    import gzip

    from ledgerlens.functions import msgpack
    from ledgerlens.sources import dumps

    rows = [(1, 1, 0, None, bytearray(msgpack.pack({"a": [1, None]}))), (2, 1, 2, bytearray(12), bytearray(msgpack.pack("x")))]
    log = spark.createDataFrame(rows, "log_index bigint, term bigint, entry_type int, request_id binary, data binary")
    names = sorted(r.name for r in dumps.dump_entries(log, str(tmp_path / "d"), as_json=True).collect())
    got = {r.name: (r.meta, bytes(r.data)) for r in dumps.read_dump(spark, str(tmp_path / "d")).collect()}
    assert sorted(got) == names == ["0" * 15 + "1", "0" * 15 + "2"]
    assert got[names[0]] == ("0:AAAAAAAAAAAAAAAA:1", b'{"a":[1,null]}') and got[names[1]] == ("2:AAAAAAAAAAAAAAAA:1", b'"x"')
    assert [tuple(r) for r in log.orderBy("log_index").select(dumps.decoded(log.data, "json"), dumps.decoded(log.data, "hex"), dumps.decoded(log.data, "length")).collect()] == [('{"a":[1,null]}', "81a1619201c0", "6"), ('"x"', "a178", "2")]
    with pytest.raises(ValueError):
        dumps.decoded(log.data, "yaml")
    values = msgpack.pack({"n": 1}) + msgpack.pack([2])
    for data, unzip in ((values, False), (gzip.compress(values), True)):
        files.write_snapshot(str(tmp_path / "snap"), 5, 1, data)
        assert [(r.seq, r.value) for r in dumps.dump_snapshot(spark, str(tmp_path / "snap"), unzip).orderBy("seq").collect()] == [(0, '{"n":1}'), (1, "[2]")]
    (tmp_path / "state").write_bytes(values)
    assert dumps.dump_state(spark, str(tmp_path / "state")).count() == 2
    with pytest.raises(Exception, match="no MessagePack"):
        dumps.dump_entries(log.withColumn("data", log.data.substr(1, 1)), str(tmp_path / "e"), as_json=True).collect()
