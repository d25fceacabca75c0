import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import consensus, feed, log, membership, replay
from ledgerlens.streaming import feed as streams


def test_votes_and_joint_votes(spark):
    v = [(1, 1, "a", True), (1, 2, "a", False), (1, 3, "b", True), (2, 1, "a", True), (2, 2, "b", False)]
    votes = spark.createDataFrame(v, "election int, seq int, peer_id string, granted boolean")
    got = {r.election: (r.votes, r.voters, r.majority_voted, r.won) for r in consensus.tally(votes, ["election"], 3).collect()}
    assert got == {1: (2, 2, True, True), 2: (1, 2, True, False)}
    members = spark.createDataFrame([("old", "a"), ("old", "b"), ("old", "c"), ("new", "a"), ("new", "d"), ("new", "e")], "side string, peer_id string")
    more = votes.union(spark.createDataFrame([(2, 3, "c", True), (2, 4, "d", True)], votes.schema))
    got = {r.election: (r.majority_voted, r.won) for r in consensus.joint_tally(more, ["election"], members).collect()}
    assert got == {1: (False, False), 2: (True, True)}


def test_majority_index_is_the_highest_with_a_majority(spark):
    rng = random.Random(5)
    rows = [(g, p, rng.randint(0, 50)) for g in range(60) for p in range(1 + g % 6)]
    d = spark.createDataFrame(rows, "g int, peer_id int, match_index bigint")
    for r in consensus.majority_index(d, ["g"]).collect():
        m = [x for g, _, x in rows if g == r.g]
        assert r.majority_index == max(n for n in {0, *m} if n == 0 or sum(x >= n for x in m) >= len(m) // 2 + 1)


def test_commit_needs_the_current_term(spark):
    lg = spark.createDataFrame([(i, 1 if i < 42 else 2) for i in range(1, 50)], "log_index bigint, term bigint")
    p = spark.createDataFrame([(2, "a", 42), (2, "b", 41), (2, "c", 42), (3, "a", 45), (3, "b", 45), (3, "c", 1)], "leader_term bigint, peer_id string, match_index bigint")
    got = {r.leader_term: (r.majority_index, r.commit_index) for r in consensus.commit_index(p, lg).collect()}
    assert got == {2: (42, 42), 3: (45, None)}


def test_joint_majority_counts_the_leader_where_it_is_a_member(spark):
    members = spark.createDataFrame([("old", "1"), ("old", "2"), ("old", "3"), ("new", "1"), ("new", "4"), ("new", "5")], "side string, peer_id string")
    p = spark.createDataFrame([("2", 42), ("3", 40), ("4", 41), ("5", 10)], "peer_id string, match_index bigint")
    assert consensus.joint_majority_index(p, members, [], own="1").first().majority_index == 41


def test_peers():
    a = membership.parse_peers(["tcp://127.0.0.1:8047", ("b", "tcp://127.0.0.1:8048"), {"id": "c", "url": "tcp://127.0.0.1:8049"}])
    assert a[0] == ("tcp://127.0.0.1:8047",) * 2 and [x for x, _ in a[1:]] == ["b", "c"]
    for bad in ([], ["x"], ["tcp://*:8047"], ["tcp://a@h:1"], ["tcp://h:1/x"], ["tcp://h"], [("a", "tcp://h:1"), ("a", "tcp://h:2")], [("a", "tcp://h:1"), ("b", "tcp://h:1")]):
        with pytest.raises(membership.PeerError):
            membership.parse_peers(bad)
    with pytest.raises(membership.PeerError):
        membership.parse_peers([("b", "tcp://h:1")], a)
    assert membership.join_configuration(a, a[:2])["new"] == a[:2]
    assert membership.join_configuration(a, a[::-1])["new"] == a[::-1]
    assert membership.join_configuration(a, a[:2], in_transition=True) is None
    with pytest.raises(membership.PeerError):
        membership.join_configuration(a, a)


def test_peer_urls_and_texts(spark):
    import ipaddress
    import random

    rng = random.Random(3)
    hosts = ["::1", "::", "1::", "::ffff:1.2.3.4", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "1::2::3", "12345::", "fe80::1:2:3:4:5:6:7", "1:2:3:4:5:6:1.2.3.4", "::1.2.3", ":1", "1:"]
    hosts += [str(ipaddress.IPv6Address(rng.getrandbits(128) & rng.getrandbits(128) & ((1 << 128) - (1 << rng.randrange(128))))) for _ in range(300)]

    def fine(h):
        try:
            return int(ipaddress.IPv6Address(h)) != 0
        except ValueError:
            return False

    urls = [f"tcp://[{h}]:8047" for h in hosts]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", membership.url_valid(F.col("u")).alias("ok")).collect()
    assert {r.u: r.ok for r in rows} == {u: fine(h) for u, h in zip(urls, hosts)}
    for u in ("tcp://1.2.3.4:8047", "tcp://[::1]:1"):
        for pid in (u, "b", "a b/c?#ü+%", "~-_.!*'()"):
            text = membership.format_peer(pid, u)
            assert membership.parse_peer_text(text) == (pid, u)
            r = spark.createDataFrame([(pid, u)], "p string, u string").select(membership.peer_text(F.col("p"), F.col("u")).alias("t"), membership.peer_of_text(F.lit(text)).alias("x")).first()
            assert r.t == text and tuple(r.x) == (pid, u)
    assert membership.parse_peer_list("tcp://1.2.3.4:1/a , tcp://1.2.3.4:2") == [("a", "tcp://1.2.3.4:1"), ("tcp://1.2.3.4:2",) * 2]
    for bad in ("tcp://1.2.3.4:1/", "tcp://h:1/a", "", "tcp://1.2.3.4:1/a,tcp://1.2.3.4:1/a"):
        with pytest.raises(membership.PeerError):
            membership.parse_peer_list(bad)
    assert spark.range(1).select(membership.peer_of_text(F.lit("tcp://1.2.3.4:1/")).alias("x")).first().x is None


def test_reads_are_ordered_bounded_and_verified(spark):
    from ledgerlens.operators import log as ops

    rows = [(i, i // 10) for i in range(1, 200)]
    log = spark.createDataFrame(rows[::-1], "log_index bigint, term bigint").repartition(5)
    assert [r.log_index for r in ops.get_entries(log, 20, 90, 1, 199).collect()] == list(range(20, 91))
    assert [r.log_index for r in ops.read_entries(log, 50, 30).collect()] == list(range(51, 81))
    assert ops.get_entries(log, 5, 4, 1, 199).count() == 0
    for a, b in ((5, 200), (0, 9)):
        with pytest.raises(ops.RangeError):
            ops.get_entries(log, a, b, 1, 199)
    assert ops.verified(ops.read_entries(log, 50), 50, 5).count() == 149
    for wrong in (log.filter("log_index <> 77"), log.withColumn("term", F.expr("if(log_index = 99, 1, term)"))):
        with pytest.raises(Exception, match="out of order at"):
            ops.verified(ops.read_entries(wrong, 50), 50).collect()
    with pytest.raises(Exception, match="out of order at 51"):
        ops.verified(ops.read_entries(log, 50), 50, 6).collect()


def test_ranges():
    assert log.parse_ranges("5,10:20,:3,90:", 1, 100) == [(5, 5), (10, 20), (1, 3), (90, 100)]
    assert log.parse_ranges(":", 1, 9) == [(1, 9)]
    for bad in ("", "0", "5:4", "1:200"):
        with pytest.raises(ValueError):
            log.parse_ranges(bad, 1, 100)


def test_append_truncate_snapshot(spark):
    lg = spark.createDataFrame([(i, 1) for i in range(1, 11)], "log_index bigint, term bigint")
    new = spark.createDataFrame([(s, 2) for s in (5, 1, 3)], "seq int, term bigint")
    got = sorted(map(tuple, log.append(lg, new, 10, index=8).collect()))
    assert got == [(i, 1) for i in range(1, 8)] + [(8, 2), (9, 2), (10, 2)]
    with pytest.raises(ValueError):
        log.append(lg, new, 10, index=12)
    assert log.install_snapshot(lg, 4, 1).count() == 6
    assert log.install_snapshot(lg, 4, 9).count() == 0
    with pytest.raises(ValueError):
        log.install_snapshot(lg, 4, 9, compact_only=True)
    assert log.snapshot_chunks(0, 10) == [(0, 0, True, True)]
    assert log.snapshot_chunks(25, 10) == [(0, 10, True, False), (10, 10, False, False), (20, 5, False, True)]
    ch = spark.createDataFrame([(1, 1, 0, bytearray(3)), (1, 2, 3, bytearray(3)), (1, 3, 7, bytearray(1))], "log_index bigint, seq int, byte_offset bigint, chunk binary")
    assert [r.seq for r in log.chunk_errors(ch).collect()] == [3]


def test_replay_equals_snapshot_and_tail(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([0, 0, 1]), 1, bytearray(rng.randbytes(5))) for i in range(1, 201)]
    lg = spark.createDataFrame(rows, "log_index bigint, entry_type int, term bigint, data binary")
    whole = replay.PassThrough(compress=True)
    assert replay.feed(whole, lg, step=37) == 200
    part = replay.PassThrough(compress=True)
    replay.feed(part, lg, upto=120)
    tail = replay.PassThrough(compress=True)
    replay.feed(tail, lg.filter("log_index > 120"), snapshot=(120, 1, part.serialize()), step=11)
    import zlib

    assert zlib.decompress(tail.serialize(), 31) == zlib.decompress(whole.serialize(), 31) == b"".join(bytes(d) for _, k, _, d in rows if k == 0)
    assert replay.feed(tail, lg, upto=50) == 200
    with pytest.raises(replay.ReplayError):
        replay.feed(replay.PassThrough(), lg.filter("log_index > 120"))
    with pytest.raises(replay.ReplayError):
        replay.feed(replay.PassThrough(), lg, upto=999)

    def fold(pdf):
        return pd.DataFrame({"entry_type": [int(pdf.entry_type.iloc[0])], "joined": [b"".join(map(bytes, pdf.data))]})

    got = {r.entry_type: bytes(r.joined) for r in replay.fold_by_key(lg, ["entry_type"], fold, "entry_type int, joined binary").collect()}
    assert got[1] == b"".join(bytes(d) for _, k, _, d in rows if k == 1)


def make_feed(spark):
    rows = [("x", 1, 1, 5, 5), ("x", 2, 1, 8, 2), ("x", 3, 1, 8, 2), ("x", 4, 1, 10, 4), ("x", 5, 1, 20, 3), ("x", 6, 1, 20, 0), ("y", 1, 1, 3, 1)]
    return spark.createDataFrame(rows, streams.FEED)


def brute(rows, strict):
    out = []
    for name in ("x", "y"):
        have = 0
        for _, arr, _, last, n in sorted(r for r in rows if r[0] == name):
            before = last - n
            if last <= have:
                continue
            if strict and before < have:
                out.append((name, arr, have + 1, last, "log"))
            else:
                if before > have:
                    out.append((name, arr, have + 1, before, "log"))
                if n:
                    out.append((name, arr, max(have, before) + 1, last, "feed"))
            have = last
    return sorted(out)


@pytest.mark.parametrize("strict", [False, True])
def test_stream_repair_equals_batch(spark, tmp_path, strict):
    f = make_feed(spark)
    for k in range(1, 7):  # a file for each arrival, read one at a time
        f.filter(F.col("arrival") == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(streams.FEED).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = []
    streams.drain(streams.gap_repair(src, strict), lambda df, n: got.extend((r.feed, r.arrival, r.first_index, r.last_index, r.source) for r in df.collect()), str(tmp_path / "check"))
    assert sorted(got) == brute([tuple(r) for r in f.collect()], strict)
    covered = sorted(i for n, _, a, b, _ in got for i in range(a, b + 1) if n == "x")
    assert covered == list(range(1, 21))


def test_feed_batch_reports(spark):
    f = make_feed(spark)
    gaps = {(r.feed, r.arrival): (r.missing, r.fresh_entries) for r in feed.gap_report(f, ["feed"]).collect()}
    assert gaps[("x", 2)] == (1, 2) and gaps[("x", 3)] == (0, 0) and gaps[("x", 4)] == (0, 2) and gaps[("x", 5)] == (7, 3) and gaps[("y", 1)] == (2, 1)
    kinds = {(r.feed, r.arrival): r.outcome for r in feed.strict_report(f, ["feed"]).collect()}
    assert kinds[("x", 1)] == "take" and kinds[("x", 3)] == "drop" and kinds[("x", 4)] == "refetch"


def test_streams_with_time(spark, tmp_path):
    rows = [("k1", "2024-01-01 00:00:00", "x", 1), ("k1", "2024-01-01 01:00:00", "x", 2), ("k2", "2024-01-01 02:00:00", "x", 3)]
    d = spark.createDataFrame(rows, "request_key string, t string, feed string, last_index bigint").withColumn("received_at", F.to_timestamp("t")).drop("t")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    src = lambda: spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    got = []
    streams.drain(streams.first_within(src(), "request_key", "received_at"), lambda df, n: got.extend(r.request_key for r in df.collect()), str(tmp_path / "c1"))
    assert sorted(got) == ["k1", "k2"]
    q = streams.peer_activity(src()).writeStream.format("memory").queryName("activity").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(pulses) from activity").first()[0] == 3
    q = streams.quiet_feeds(src()).writeStream.format("memory").queryName("quiet").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select * from quiet").count() == 3


def test_transitions_cover_all_pairs(spark):
    names = [consensus.CLIENT, consensus.FOLLOWER, consensus.CANDIDATE, consensus.LEADER]
    rows = [(i, s, st) for i, pair in enumerate(itertools.permutations(names, 2)) for s, st in enumerate(pair)]
    bad = consensus.bad_transitions(spark.createDataFrame(rows, "peer_id int, seq int, state string")).collect()
    assert {(r.before, r.state) for r in bad} == set(itertools.permutations(names, 2)) - set(consensus.TRANSITIONS)
