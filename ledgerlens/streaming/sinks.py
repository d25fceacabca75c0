"""Stream sinks: appending entries to a log, publishing a feed, installing snapshots as they come."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.sources import files, formats, rlog


def log_appender(path: str, capacity: int = formats.DEFAULT_CAPACITY) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer of entries(log_index, term, entry_type, request_id, data).

    Entries at or below the log's end are dropped (a batch that is run again changes nothing);
    a hole is an error. The last segment is written anew with what it holds already; segment
    files appear whole, on the commit of the write.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seg = rlog.inspect_segments(spark, path).filter("entry_count > 0") if os.path.isdir(path) and os.listdir(path) else None
        top = seg.agg(F.max("next_index").alias("n"), F.max("segment_first_index").alias("s"), F.min("segment_first_index").alias("f")).first() if seg is not None else None
        nxt, last_segment, first = (top.n, top.s, top.f) if top and top.n else (1, None, 1)
        new = batch.filter(F.col("log_index") >= nxt).select("log_index", "term", "entry_type", "request_id", "data").cache()
        b = new.agg(F.min("log_index").alias("a"), F.max("log_index").alias("b"), F.countDistinct("log_index").alias("n"), F.count(F.lit(1)).alias("all")).first()
        if b.a is None:
            return
        if b.a != nxt or b.b - b.a + 1 != b.n or b.n != b.all:
            raise ValueError(f"entries {b.a} to {b.b} do not continue the log at {nxt}")
        whole = new
        if last_segment is not None and nxt % capacity:
            held = rlog.read_log(spark, path, last_segment, nxt - 1).select(*new.columns)
            whole = held.unionByName(new)
        rlog.write_log(whole, path, capacity, first)
        new.unpersist()

    return write


def feed_publisher(path: str, secret: bytes = b"", most: int = 4096) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer of feed rows (term, last_index, n, entries): each batch's entries by term and ``most`` indexes at most."""

    def write(batch: DataFrame, number: int) -> None:
        part = F.floor(F.col("log_index") / most)
        by = batch.groupBy("term", part.alias("_part")).agg(F.max("log_index").alias("last_index"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("log_index", "data"))).alias("entries"))
        by.select(F.lit(secret).alias("secret"), "term", "last_index", "n", "entries").write.mode("append").parquet(path)

    return write


def snapshot_installer(log_path: str, install: Callable[[SparkSession, dict], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer for a binary file stream of snapshots: the newest of a batch is installed."""

    def write(batch: DataFrame, number: int) -> None:
        newest = batch.orderBy(F.desc("modificationTime")).select("path").limit(1).collect()
        for r in newest:
            meta, _ = files.read_snapshots(batch.sparkSession, r.path)
            install(batch.sparkSession, meta.first().asDict())

    return write
