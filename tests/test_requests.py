"""Configuration texts, table functions, and streams that fetch gaps and send pulses."""

import time

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import codec
from ledgerlens.operators import requests
from ledgerlens.sources import files, hjson
from ledgerlens.streaming import feed as streams

HJSON = """
# raft's own part
raft: {
  id: example-hjson   // this belongs to the comment-less text
  "secret": 'it''s'
  port: 8047 # a number
  rate: -1.5e2, on: true
  none: null
  peers: [
    tcp://127.0.0.1:8047
    {id: "2", url: "tcp://127.0.0.1:8227"}
    [1, 2,]
  ]
}
/* other
   parts */
other.cfg: {y: {z: 2}}
note:
  '''
  first
    second
  '''
"""


def test_hjson():
    got = hjson.loads(HJSON.replace("'it''s'", '"it\'s"'))
    raft = got["raft"]
    assert raft["id"] == "example-hjson   // this belongs to the comment-less text" and raft["secret"] == "it's"
    assert (raft["port"], raft["rate"], raft["on"], raft["none"]) == (8047, -150.0, True, None)
    assert raft["peers"] == ["tcp://127.0.0.1:8047", {"id": "2", "url": "tcp://127.0.0.1:8227"}, [1, 2]]
    assert got["other.cfg"] == {"y": {"z": 2}} and got["note"] == "first\n  second"
    assert hjson.loads("{a: 1\nb: [x\ny]}".replace("y]", "y\n]")) == {"a": 1, "b": ["x", "y"]}
    assert hjson.loads("") == {} and hjson.loads("[1 2]".replace(" ", ", ")) == [1, 2] and hjson.loads("17") == 17
    assert hjson.loads("k: 'a \"b\" \\'c'") == {"k": "a \"b\" 'c"}
    for bad in ("{a: 1", "a: [1", "{a 1}", "a:", "{a: 1} b"):
        with pytest.raises(ValueError):
            hjson.loads(bad)


def test_config_kinds(tmp_path):
    (tmp_path / "a.hjson").write_text("raft: {x: 1}\nother.cfg: {y: text here\n}")
    assert files.read_config(str(tmp_path / "a.hjson"), "other.cfg") == {"y": "text here"}
    (tmp_path / "a.yml").write_text("raft:\n  x: 1\n  peers:\n    - tcp://a:1\n")
    try:
        import yaml  # noqa: F401
    except ImportError:
        with pytest.raises(ValueError):
            files.read_config(str(tmp_path / "a.yml"), "raft")
    else:
        assert files.read_config(str(tmp_path / "a.yml"), "raft") == {"x": 1, "peers": ["tcp://a:1"]}


def test_idents(spark):
    name = codec.writer_name("host", 70000)
    assert len(name) == 5 and name[3:] == (70000 - 65536).to_bytes(2, "big")
    got = spark.range((1 << 24) - 1, (1 << 24) + 1, 1, 1).select(codec.new_ident(F.lit(1 << 31), F.lit(name), F.col("id")).alias("i"))
    assert [bytes(r.i) for r in got.collect()] == [b"\x80\0\0\0" + name + b"\xff\xff\xff", b"\x80\0\0\0" + name + b"\0\0\0"]
    assert spark.range(1).select(codec.id_seconds(codec.new_ident(F.lit(77), F.lit(name), F.lit(5))).alias("s")).first().s == 77


def test_table_function(spark):
    class Count:
        def eval(self, n: int):
            for i in range(n):
                yield (i,)

    requests.table_function(spark, "count_up", Count, "i int")
    assert [r.i for r in spark.sql("select i from count_up(3) order by i").collect()] == [0, 1, 2]
    none = requests.serve(spark.createDataFrame([(1, "x", ["a"])], "message_id long, message_type string, args array<string>"), {})
    assert none.columns == ["message_id", "reply"] and none.count() == 0


def test_gaps_are_fetched_in_the_stream(spark, tmp_path):
    log = spark.range(1, 31).select(F.col("id").alias("log_index"), (F.col("id") * 2).alias("term")).cache()
    spark.createDataFrame([("x", 1, 1, 5, 5), ("x", 2, 1, 9, 2), ("x", 3, 1, 9, 4), ("x", 4, 1, 20, 1)], streams.FEED).coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(streams.FEED).parquet(str(tmp_path / "in"))
    got = []
    step = streams.entry_subscriber(lambda s, a, b: log.filter(F.col("log_index").between(a, b)), lambda df, n: got.extend((r.log_index, r.term, r.source) for r in df.collect()))
    streams.drain(streams.gap_repair(src), step, str(tmp_path / "check"))
    fetched = {6, 7} | set(range(10, 20))
    assert sorted(got) == [(i, 2 * i, "log" if i in fetched else "feed") for i in range(1, 21)]


def test_heartbeats_in_the_stream(spark, tmp_path):
    spark.createDataFrame([("x", 1, 3, 5, 5), ("x", 2, 4, 9, 2)], streams.FEED).coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(streams.FEED).parquet(str(tmp_path / "in"))
    got = []
    q = streams.with_heartbeats(src, 200).writeStream.foreachBatch(lambda df, n: got.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="100 milliseconds").start()
    end = time.time() + 60
    while len(got) < 4 and time.time() < end and q.isActive:
        time.sleep(0.2)
    q.stop()
    assert got[:2] == [("x", 1, 3, 5, 5), ("x", 2, 4, 9, 2)]
    assert len(got) >= 4 and set(got[2:]) == {("x", 2, 4, 9, 0)}
