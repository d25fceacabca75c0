"""Reports of the tools: inspection, listings, cluster status, monitor messages, load generation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.functions import codec
from ledgerlens.sources import files, rlog


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, report): a JSON report of every file below path; state and other files report their size."""
    kinds = files.file_kinds(spark, path)
    seg = rlog.inspect_segments(spark, path).withColumnRenamed("path", "_p")
    seg = seg.select("_p", F.to_json(F.struct(*[c for c in seg.columns if c != "_p"])).alias("_r"))
    plain = F.to_json(F.struct("length"))
    return kinds.join(seg, F.col("path") == F.col("_p"), "left").select("path", "kind", F.coalesce("_r", plain).alias("report"))


def inspect_log(spark: SparkSession, path: str) -> DataFrame:
    """One row: first and last index, last term, segments, entries and bytes of a log directory; empty tail segments count for nothing."""
    seg = rlog.inspect_segments(spark, path).filter("entry_count > 0")
    top = seg.agg(F.min("segment_first_index").alias("first_index"), (F.max("next_index") - 1).alias("last_index"), F.count(F.lit(1)).alias("segments"), F.sum("entry_count").cast("bigint").alias("entries"), F.sum("data_size").alias("bytes")).first()
    if not top.segments:
        return spark.createDataFrame([(1, 0, 0, 0, 0, 0)], "first_index bigint, last_index bigint, last_term bigint, segments bigint, entries bigint, bytes bigint")
    last = rlog.read_log(spark, path, top.last_index, top.last_index, payload=False).select(F.col("term").alias("last_term"))
    fixed = [F.lit(top[c]).cast("bigint").alias(c) for c in ("first_index", "last_index")]
    return last.select(*fixed, "last_term", *[F.lit(top[c]).cast("bigint").alias(c) for c in ("segments", "entries", "bytes")])


def monitor_message(info: DataFrame, columns: list[str]) -> DataFrame:
    """(peer_id, message): what a monitor sends of a peer, as one server-sent event."""
    return info.select("peer_id", F.concat(F.lit("event: raft\ndata: "), F.to_json(F.struct(*columns)), F.lit("\n\n")).alias("message"))


def cluster_status(info: DataFrame, own_leader: str = "is_leader") -> DataFrame:
    """Per peer, how far it lags behind the leader's commit index; null where no leader is known."""
    lead = info.filter(F.col(own_leader)).agg(F.max("commit_index").alias("_c"))
    return info.join(F.broadcast(lead)).select(*info.columns, (F.col("_c") - F.col("last_index")).alias("behind"))


def final_config(log: DataFrame, after: int) -> DataFrame:
    """The first CONFIG entry after an index: the one that a membership change ends with."""
    return log.filter((F.col("entry_type") == codec.CONFIG) & (F.col("log_index") > after)).agg(F.min("log_index").alias("log_index"))


def snapshot_transfer(steps: DataFrame) -> DataFrame:
    """steps(peer_id, position, size, chunk, same_snapshot, wanted) + (next_position, done): the sender's
    next position: the follower's wish within the size, 0 if the snapshot was replaced."""
    c = F.col
    nxt = F.when(~c("same_snapshot"), F.lit(0)).when(c("wanted").isNotNull(), F.greatest(F.lit(0), F.least(c("wanted"), c("size")))).otherwise(F.least(c("position") + c("chunk"), c("size")))
    return steps.select("peer_id", nxt.cast("bigint").alias("next_position"), (c("same_snapshot") & (nxt >= c("size"))).alias("done"))


def quiet_peers(pulses: DataFrame, limit_ms: int = 1500) -> DataFrame:
    """Messages of peers after which nothing came for over ``limit_ms``."""
    w = Window.partitionBy("peer_id").orderBy("received_ms")
    out = pulses.withColumn("quiet_ms", F.lead("received_ms").over(w) - F.col("received_ms"))
    return out.filter(F.col("quiet_ms") > limit_ms).select("peer_id", "received_ms", "quiet_ms")


def flood(spark: SparkSession, entries: int, seed: int = 1, burst: int = 100, per_second: int = 10, start: int = 1704067200, parts: int = 8) -> DataFrame:
    """A made-up log of bursts of 1 to ``burst`` updates, the same for the same seed."""
    n = F.col("id") + 1
    h = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(1 << 31))
    rid = F.unhex(F.concat(F.lpad(F.hex(F.lit(start) + F.floor(F.col("id") / per_second)), 8, "0"), F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")).cast("binary")), 1, 16)))
    data = F.concat(F.lit("iteration "), n.cast("string"), F.repeat(F.lit("."), (h(1) % burst).cast("int"))).cast("binary")
    return spark.range(0, entries, 1, parts).select(n.alias("log_index"), F.lit(1).cast("bigint").alias("term"), F.lit(0).alias("entry_type"), rid.alias("request_id"), data.alias("data"))


def verify_flood(log: DataFrame) -> DataFrame:
    """Entries whose iteration does not follow the one of the entry before: a self-join, no global order."""
    it = F.regexp_extract(F.col("data").cast("string"), r"^iteration (\d+)", 1).cast("bigint")
    at = log.select("log_index", it.alias("iteration"))
    prev = at.select((F.col("log_index") + 1).alias("_i"), F.col("iteration").alias("_before"))
    return at.join(prev, F.col("log_index") == F.col("_i")).filter(F.col("iteration") != F.col("_before") + 1).select("log_index", "iteration", "_before")

