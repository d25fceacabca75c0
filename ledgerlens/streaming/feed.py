"""Change feeds as Structured Streams: gap repair, deduplication, liveness and sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FEED = "feed string, arrival bigint, term bigint, last_index bigint, n bigint"
REPAIR = "feed string, arrival bigint, first_index bigint, last_index bigint, source string, stale bigint"


def gap_repair(feed: DataFrame, strict: bool = False, start: int = 0) -> DataFrame:
    """feed(FEED) -> ranges to deliver (REPAIR), in order and without overlap for each feed.

    source 'feed': these indexes come from the batch; 'log': they are missing and to be read
    from the log (stale says how many). Batches within a trigger are taken in the order of
    arrival. Overlapping parts are trimmed; in strict mode a batch that overlaps in part is
    read again from the log instead, and one that is wholly old is dropped.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        have = state.get[0] if state.exists else start
        rows = pd.concat(list(batches)).sort_values(["arrival", "last_index"], kind="stable")
        out = []
        for r in rows.itertuples(index=False):
            before = r.last_index - r.n
            if r.last_index <= have or r.n == 0 and before <= have:
                continue
            if strict and before < have:
                out.append((key[0], r.arrival, have + 1, r.last_index, "log", r.last_index - have))
            else:
                if before > have:
                    out.append((key[0], r.arrival, have + 1, before, "log", before - have))
                if r.n:
                    out.append((key[0], r.arrival, max(before, have) + 1, r.last_index, "feed", 0))
            have = int(r.last_index)
        state.update((have,))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in REPAIR.split(", ")])

    return feed.groupBy("feed").applyInPandasWithState(step, REPAIR, "have bigint", "append", GroupStateTimeout.NoTimeout)


def entry_subscriber(read: Callable[[SparkSession, int, int], DataFrame], write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer for the ranges of ``gap_repair``: write gets their entries, with (feed, source).

    read(spark, first, last) gives the log's entries of a range of indexes; gaps are thus fetched within the stream.
    """

    def step(ranges: DataFrame, number: int) -> None:
        ranges.persist()  # the repair's state must not be gone through twice
        try:
            bounds = ranges.agg(F.min("first_index").alias("a"), F.max("last_index").alias("b")).first()
            if bounds.a is not None:
                wanted = ranges.select("feed", "source", F.explode(F.sequence("first_index", "last_index")).alias("log_index"))
                write(wanted.join(read(ranges.sparkSession, bounds.a, bounds.b), "log_index"), number)
        finally:
            ranges.unpersist()

    return step


def with_heartbeats(feed: DataFrame, every_ms: int = 500) -> DataFrame:
    """feed(FEED) as it comes, and a row without entries whenever ``every_ms`` have gone by without one.

    Pulses are sent by processing time, at triggers; they repeat the last arrival, term and last index.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in FEED.split(", ")]
        if state.hasTimedOut:
            arrival, term, last = state.get
            yield pd.DataFrame([(key[0], arrival, term, last, 0)], columns=names)
        else:
            rows = pd.concat(list(batches)).sort_values(["arrival", "last_index"], kind="stable")
            top = rows.iloc[-1]
            state.update((int(top.arrival), int(top.term), int(top.last_index)))
            yield rows[names]
        state.setTimeoutDuration(every_ms)

    return feed.groupBy("feed").applyInPandasWithState(step, FEED, "arrival bigint, term bigint, last_index bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)


def first_within(requests: DataFrame, key: str, at: str, ttl: str = "8 hours") -> DataFrame:
    """Requests whose key has not been seen within the time to live (event time)."""
    return requests.withWatermark(at, ttl).dropDuplicatesWithinWatermark([key])


def peer_activity(pulses: DataFrame, at: str = "received_at", width: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Pulses of each feed and window: a window without any has no row."""
    return pulses.withWatermark(at, late).groupBy("feed", F.window(at, width)).agg(F.count(F.lit(1)).alias("pulses"), F.max("last_index").alias("last_index"))


def quiet_feeds(pulses: DataFrame, at: str = "received_at", gap: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Spells of activity that a silence of ``gap`` ends."""
    w = F.session_window(at, gap)
    return pulses.withWatermark(at, late).groupBy("feed", w).agg(F.count(F.lit(1)).alias("pulses")).select("feed", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("quiet_from"), "pulses")


def tail_log(spark: SparkSession, path: str, start: int = 1, payload: bool = True) -> DataFrame:
    """New entries of a log directory; the checkpoint holds the next index."""
    from ledgerlens.sources import rlog

    rlog.register(spark)
    return spark.readStream.format("rlog").option("path", path).option("startIndex", str(start)).option("payload", str(payload).lower()).load()


def drain(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Runs a stream over all that is there now; write gets each batch and its number."""
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
