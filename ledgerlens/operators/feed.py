"""Change feeds in batch form: gaps, overlaps, freshness and silence of recorded broadcasts.

A feed row is (arrival, term, last_index, n): n entries that end at last_index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import codec


def _with_have(feed: DataFrame, by: list[str], start: int, block: int = 4096) -> DataFrame:
    """feed + _have: the highest last index before each arrival.

    Highest indexes of blocks of arrival numbers are put in order first (a row a block), so
    batches are only ordered within their blocks, each in a task of its own.
    """
    keyed = feed.withColumn("_block", F.floor(F.col("arrival").cast("double") / block))
    tops = keyed.groupBy(*by, "_block").agg(F.max("last_index").alias("_top"))
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = tops.withColumn("_before", F.max("_top").over(earlier)).alias("s")
    inside = Window.partitionBy(*by, "_block").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    here = keyed.withColumn("_in", F.max("last_index").over(inside)).alias("f")
    same = F.lit(True)
    for c in (*by, "_block"):
        same = same & F.col(f"f.{c}").eqNullSafe(F.col(f"s.{c}"))
    have = F.greatest(F.col("_in"), F.col("_before"), F.lit(start))  # nulls are passed over
    return here.join(starts, same).select(*(F.col(f"f.{c}") for c in feed.columns), have.alias("_have"))


def gap_report(feed: DataFrame, by: list[str], start: int = 0) -> DataFrame:
    """feed + (missing, fresh_entries): entries to fetch before the batch, and its entries that are new.

    What a subscriber has is the running maximum of the last indexes, as gaps are repaired.
    """
    before = F.col("last_index") - F.col("n")
    out = _with_have(feed, by, start)
    fresh = F.greatest(F.lit(0), F.least(F.col("n"), F.col("last_index") - F.col("_have")))
    return out.select(*feed.columns, F.greatest(F.lit(0), before - F.col("_have")).cast("bigint").alias("missing"), fresh.cast("bigint").alias("fresh_entries"))


def strict_report(feed: DataFrame, by: list[str], start: int = 0) -> DataFrame:
    """feed + outcome of a reader that takes exact continuations only and refetches after any other."""
    out = _with_have(feed, by, start)
    outcome = F.when(F.col("last_index") - F.col("n") == F.col("_have"), "take").when(F.col("last_index") <= F.col("_have"), "drop").otherwise("refetch")
    return out.select(*feed.columns, outcome.alias("outcome"))


def signals(feed: DataFrame, by: list[str], start: int = 0) -> DataFrame:
    """(by, arrival, signal, missing): 'stale' with the count of entries to fetch where a batch leaves a gap,
    'fresh' where the gap is closed and at a feed's first batch."""
    gaps = gap_report(feed, by, start)
    first = feed.groupBy(*by).agg(F.min("arrival").alias("_first"))
    met = gaps.join(first, by)
    none = F.lit(None).cast("bigint")
    stale = F.struct(F.lit("stale").alias("signal"), F.col("missing").alias("missing"))
    fresh = F.struct(F.lit("fresh").alias("signal"), none.alias("missing"))
    said = F.when(F.col("missing") > 0, F.array(stale, fresh)).when(F.col("arrival") == F.col("_first"), F.array(fresh))
    return met.select(*by, "arrival", F.explode(said).alias("_s")).select(*by, "arrival", "_s.signal", "_s.missing")


def heartbeats(feed: DataFrame, by: list[str], until_ms: int, every_ms: int = 500) -> DataFrame:
    """feed(by, sent_ms, term, last_index) -> the pulses without entries (n = 0) that are sent each ``every_ms``
    after a batch, up to the next one or, after the last, to ``until_ms``."""
    w = Window.partitionBy(*by).orderBy("sent_ms", "last_index")
    end = F.coalesce(F.lead("sent_ms").over(w), F.lit(until_ms))
    at = feed.withColumn("_beats", F.floor((end - F.col("sent_ms") - 1) / every_ms)).filter("_beats > 0")
    at = at.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("bigint"), "_beats")))
    return at.select(*by, (F.col("sent_ms") + F.col("_k") * every_ms).alias("sent_ms"), "term", "last_index", F.lit(0).cast("bigint").alias("n"))


def config_in_force(log: DataFrame) -> DataFrame:
    """(log_index, peers_index): the last CONFIG entry up to each entry, 0 before the first, as a reader of the log takes them over."""
    mark = F.when(F.col("entry_type") == codec.CONFIG, F.col("log_index"))
    at = _with_have(log.select(F.col("log_index").alias("arrival"), mark.alias("last_index")), [], 0)
    return at.select(F.col("arrival").alias("log_index"), F.greatest("_have", "last_index").cast("bigint").alias("peers_index"))


def caught_up(log: DataFrame, applied_index: int, current_term: int, peers_index: int) -> DataFrame:
    """One row: last index, term and configuration of a reader outside the cluster that has read all that came after ``applied_index``."""
    new = log.filter(F.col("log_index") > applied_index)
    whole = lambda x, least: F.coalesce(F.greatest(x, F.lit(least)), F.lit(least)).cast("bigint")
    config = F.max(F.when(F.col("entry_type") == codec.CONFIG, F.col("log_index")))
    return new.agg(whole(F.max("log_index"), applied_index).alias("last_index"), whole(F.max_by("term", "log_index"), current_term).alias("current_term"), whole(config, peers_index).alias("peers_index"))


def repaired(feed: DataFrame, log: DataFrame) -> DataFrame:
    """Entries that a subscriber ends up with: those of batches, and gaps fetched from the log.

    Batches overlap and come twice; each index is delivered once, by the feed where it can.
    """
    sent = feed.select(F.explode(F.sequence(F.col("last_index") - F.col("n") + 1, F.col("last_index"))).alias("_i")).distinct()
    top = feed.agg(F.max("last_index").alias("_top"))
    met = log.join(F.broadcast(top), F.col("log_index") <= F.col("_top")).join(sent, F.col("log_index") == F.col("_i"), "left")
    return met.select("log_index", "term", F.col("_i").isNull().alias("fetched"))


def silences(pulses: DataFrame, by: list[str], heartbeat_ms: int = 500) -> DataFrame:
    """Times without any pulse for over twice the heartbeat (100 ms at least)."""
    limit = max(2 * heartbeat_ms, 100)
    w = Window.partitionBy(*by).orderBy("received_ms")
    out = pulses.withColumn("quiet_ms", F.lead("received_ms").over(w) - F.col("received_ms"))
    return out.filter(F.col("quiet_ms") > limit).select(*by, "received_ms", "quiet_ms")


def visible(log: DataFrame, applied_index: int) -> DataFrame:
    """Nothing above what has been applied is visible to readers."""
    return log.filter(F.col("log_index") <= applied_index)


def accepted_secret(messages: DataFrame, secret: bytes) -> DataFrame:
    return messages.filter(F.col("secret") == F.lit(secret))


def next_apply_ok(batches: DataFrame) -> DataFrame:
    """batches(seq, next_index, n, snapshot_index), seq dense from 1: those that do not continue what was applied.

    A self-join on the batch before: no global order is needed.
    """
    prev = batches.select((F.col("seq") + 1).alias("_s"), (F.col("next_index") + F.col("n") - 1).alias("_applied"))
    want = F.coalesce(F.col("snapshot_index"), F.col("_applied"), F.lit(0)) + 1
    met = batches.join(prev, F.col("seq") == F.col("_s"), "left")
    return met.select(*batches.columns, want.alias("expected")).filter(F.col("next_index") != F.col("expected"))
