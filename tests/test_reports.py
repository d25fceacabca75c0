import json

from pyspark.sql import functions as F

from ledgerlens.operators import reports
from ledgerlens.sources import files, rlog
from ledgerlens.streaming import feed, sinks


def test_flood_write_inspect(spark, tmp_path):
    log = reports.flood(spark, 700, seed=3)
    assert log.collect() == reports.flood(spark, 700, seed=3, parts=3).collect()
    assert reports.verify_flood(log).count() == 0
    rlog.write_log(log, str(tmp_path / "log"), capacity=256)
    files.write_snapshot(str(tmp_path / "log" / "snap"), 0, 0, b"")
    got = {r.kind: json.loads(r.report) for r in reports.inspect(spark, str(tmp_path / "log")).collect()}
    assert set(got) == {"segment", "snapshot"} and got["segment"]["capacity"] in (255, 256)
    b = reports.inspect_log(spark, str(tmp_path / "log")).first()
    assert (b.first_index, b.last_index, b.last_term, b.segments, b.entries) == (1, 700, 1, 3, 700)


def test_streamed_appends_survive_being_run_again(spark, tmp_path):
    log = reports.flood(spark, 300)
    for k in range(3):
        log.filter(F.col("log_index").between(100 * k + 1, 100 * k + 100)).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{k}"))
    write = sinks.log_appender(str(tmp_path / "log"), capacity=64)
    (tmp_path / "log").mkdir()
    batches = [spark.read.parquet(str(tmp_path / f"in/{k}")) for k in range(3)]
    for n, b in enumerate([batches[0], batches[1], batches[1], batches[2]]):
        write(b, n)
    got = rlog.read_log(spark, str(tmp_path / "log")).select("log_index", "data").orderBy("log_index").collect()
    assert got == log.select("log_index", "data").orderBy("log_index").collect()
    try:
        write(log.filter("log_index = 300").withColumn("log_index", F.lit(999)), 5)
        raise AssertionError("a hole was taken")
    except ValueError:
        pass
    publish = sinks.feed_publisher(str(tmp_path / "feed"), b"s")
    feed.drain(feed.tail_log(spark, str(tmp_path / "log")), publish, str(tmp_path / "check"))
    f = spark.read.parquet(str(tmp_path / "feed")).first()
    assert (f.last_index, f.n, bytes(f.secret)) == (300, 300, b"s")
    files.write_snapshot(str(tmp_path / "snap"), 42, 7, b"x")
    seen = []
    sinks.snapshot_installer(str(tmp_path / "log"), lambda s, m: seen.append((m["log_index"], m["log_term"])))(spark.read.format("binaryFile").load(str(tmp_path / "snap")), 0)
    assert seen == [(42, 7)]
