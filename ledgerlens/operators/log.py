"""Reads, windows and reports over a log DataFrame with a dense log_index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import codec


class RangeError(ValueError):
    """A range that the log does not hold."""


def get_entry(log: DataFrame, index: int) -> DataFrame:
    return log.filter(F.col("log_index") == index)


def _range(log: DataFrame, first: int, last: int) -> DataFrame:
    return log.filter(F.col("log_index").between(first, last))


def get_entries(log: DataFrame, first: int, last: int, first_index: int | None = None, last_index: int | None = None) -> DataFrame:
    """Inclusive range in log order; nothing where last < first.

    Where the bounds of the log are given, a range that reaches beyond them is an error.
    """
    if last_index is not None and last > last_index:
        raise RangeError(f"{last} is beyond the last index {last_index}")
    if first_index is not None and first <= last and first < first_index:
        raise RangeError(f"{first} is before the first index {first_index}")
    return _range(log, first, last).orderBy("log_index")


def read_entries(log: DataFrame, prev_index: int, count: int | None = None, upper: int | None = None) -> DataFrame:
    """Entries after prev_index in log order: indexes are dense, so a limit is a range and reaches the scan."""
    last = [x for x in (upper, prev_index + count if count is not None and count > 0 else None) if x is not None]
    if count == 0:
        return log.filter(F.lit(False))
    out = log.filter(F.col("log_index") > prev_index)
    return (out.filter(F.col("log_index") <= min(last)) if last else out).orderBy("log_index")


def verified(entries: DataFrame, prev_index: int, prev_term: int | None = None) -> DataFrame:
    """entries, of which reading one fails that does not follow its predecessor (dense indexes, terms that don't fall).

    The predecessor comes by a self-join, that of the first is prev_index with prev_term.
    """
    at = entries.alias("a")
    before = entries.select((F.col("log_index") + 1).alias("_i"), F.col("term").alias("_t"))
    met = at.join(before, F.col("a.log_index") == F.col("_i"), "left")
    first = F.col("a.log_index") == prev_index + 1
    gap = F.col("_i").isNull() & ~first
    falls = F.col("a.term") < F.coalesce("_t", F.when(first, F.lit(prev_term).cast("bigint")))
    said = F.concat(F.lit("entries out of order at "), F.col("a.log_index").cast("string"))
    wrong = F.coalesce(gap | falls, F.lit(False))
    index = F.when(wrong, F.raise_error(said).cast("bigint")).otherwise(F.col("a.log_index"))
    return met.select(*(index.alias(c) if c == "log_index" else F.col(f"a.`{c}`") for c in entries.columns))


def running_size(log: DataFrame, block: int = 1024) -> DataFrame:
    """log + running byte count. Sums of blocks of indexes are added up first (a row a block), so
    entries are only ordered within their blocks, each in a task of its own."""
    at = F.floor(F.col("log_index") / block).cast("bigint")
    keyed = log.withColumn("_block", at)
    sums = keyed.groupBy("_block").agg(F.sum("entry_size").alias("_bytes"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("_block").alias("_b"), F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_block").orderBy("log_index").rowsBetween(Window.unboundedPreceding, 0)
    out = keyed.withColumn("_in", F.sum("entry_size").over(inside)).join(starts, F.col("_block") == F.col("_b"))
    return out.select(*log.columns, (F.col("_in") + F.col("_before")).cast("bigint").alias("running_bytes"))


def read_budget(log: DataFrame, first: int, last: int, budget: int) -> DataFrame:
    """Longest prefix of a range whose size is within the budget, at least one entry.

    Entries hold at least one byte, so no more than ``budget`` of them can fit.
    """
    part = _range(log, first, min(last, first + max(budget, 1)))
    return running_size(part).filter((F.col("running_bytes") <= budget) | (F.col("log_index") == first))


def count_fitting(log: DataFrame, first: int, budget: int) -> DataFrame:
    """One row: how many entries from first on fit into the budget (0 if none)."""
    part = _range(log, first, first + max(budget, 1))
    return running_size(part).filter(F.col("running_bytes") <= budget).agg(F.count(F.lit(1)).alias("fitting"))


def term_at(log: DataFrame, wanted: DataFrame, snapshot_index: int | None = None, snapshot_term: int | None = None) -> DataFrame:
    """wanted(index) + term: the entry's, the snapshot's at its index, null elsewhere."""
    terms = log.select(F.col("log_index").alias("_i"), F.col("term").alias("_t"))
    out = wanted.join(terms, wanted["index"] == F.col("_i"), "left")
    fallback = F.when(F.col("index") == F.lit(snapshot_index), F.lit(snapshot_term)) if snapshot_index is not None else F.lit(None)
    return out.select(*wanted.columns, F.coalesce("_t", fallback.cast("bigint")).alias("term"))


def segments(log: DataFrame, capacity: int, log_first: int = 1) -> DataFrame:
    """One row per segment: counts, bounds and sizes."""
    first = codec.segment_first_index(F.col("log_index"), capacity, log_first)
    agg = log.groupBy(first.alias("segment_first_index")).agg(F.count(F.lit(1)).alias("entry_count"), F.sum("entry_size").cast("bigint").alias("data_size"), F.max("log_index").alias("last_index"))
    room = F.lit(capacity) - F.col("segment_first_index") % capacity
    return agg.select("segment_first_index", room.cast("bigint").alias("capacity"), "entry_count", (F.col("last_index") + 1).alias("next_index"), (room - F.col("entry_count")).cast("bigint").alias("free_count"), "data_size", (16 + 4 * room).cast("bigint").alias("index_size"), (F.col("segment_first_index") + room - 1).cast("bigint").alias("last_allowed_index"))


def byte_offsets(log: DataFrame, capacity: int) -> DataFrame:
    """log + byte_offset of each entry within its segment's data."""
    seg = codec.segment_first_index(F.col("log_index"), capacity)
    w = Window.partitionBy("_seg").orderBy("log_index").rowsBetween(Window.unboundedPreceding, -1)
    out = log.withColumn("_seg", seg)
    return out.select(*log.columns, F.col("_seg").alias("segment"), F.coalesce(F.sum("entry_size").over(w), F.lit(0)).cast("bigint").alias("byte_offset"))


def bounds(log: DataFrame) -> DataFrame:
    """One row: first and last index, last term, entries and bytes; 0 where the log is empty."""
    zero = F.lit(0).cast("bigint")
    return log.agg(F.coalesce(F.min("log_index"), zero + 1).alias("first_index"), F.coalesce(F.max("log_index"), zero).alias("last_index"), F.coalesce(F.max_by("term", "log_index"), zero).alias("last_term"), F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("entry_size"), zero).cast("bigint").alias("bytes"))


def contiguity_errors(log: DataFrame, block: int = 1024) -> DataFrame:
    """Entries whose predecessor is missing, or whose term is below their predecessor's.

    A self-join on the index before: no global order is needed.
    """
    prev = log.select((F.col("log_index") + 1).alias("_i"), F.col("term").alias("_t"))
    first = log.agg(F.min("log_index").alias("_first"))
    met = log.join(prev, log.log_index == F.col("_i"), "left").join(F.broadcast(first), F.col("log_index") > F.col("_first"))
    return met.select("log_index", "term", F.col("_i").isNull().alias("gap"), (F.col("term") < F.col("_t")).alias("term_falls")).filter("gap or term_falls")


def gaps_by_key(log: DataFrame, key: str, least: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy("log_index")
    out = log.withColumn("gap", F.col("log_index") - F.lag("log_index").over(w))
    return out.filter(F.col("gap") > least).select(key, "log_index", "gap")


def term_spans(log: DataFrame) -> DataFrame:
    return log.groupBy("term").agg(F.min("log_index").alias("first_index"), F.max("log_index").alias("last_index"), F.count(F.lit(1)).alias("entries"))


def fold_last(log: DataFrame, keys: list[str], value: str, at: str = "log_index") -> DataFrame:
    """Last writer wins by key; a null that was written is a value."""
    return log.groupBy(*keys).agg(F.max(at).alias(at), F.max_by(F.struct(value), at)[value].alias(value))


def truncate(log: DataFrame, index: int) -> DataFrame:
    return log.filter(F.col("log_index") < index)


def append(log: DataFrame, new: DataFrame, last_index: int, index: int | None = None) -> DataFrame:
    """log up to index, then new(seq, ...) in the order of seq with dense indexes from index on.

    Where arrival numbers are dense already, indexes follow by arithmetic; only numbers with
    holes are ranked, which takes one task for the rows of the call.
    """
    at = last_index + 1 if index is None else index
    if at > last_index + 1:
        raise ValueError(f"non linear addition: {at} after {last_index}")
    if at < 1:
        raise ValueError("indexes begin at 1")
    b = new.agg(F.min("seq").alias("a"), F.max("seq").alias("b"), F.countDistinct("seq").alias("d"), F.count(F.lit(1)).alias("n")).first()
    dense = b.n == 0 or b.b - b.a + 1 == b.d == b.n
    number = F.col("seq") - F.lit(b.a or 0) if dense else F.row_number().over(Window.orderBy("seq")) - 1
    numbered = new.withColumn("log_index", (number + at).cast("bigint")).drop("seq")
    return truncate(log, at).unionByName(numbered.select(*log.columns))


def listing_row(index: Column, offset: Column, size: Column) -> Column:
    """index:offset:size in padded hex."""
    return F.concat_ws(":", F.lpad(F.lower(F.hex(index)), 14, "0"), F.lpad(F.lower(F.hex(offset)), 8, "0"), F.lpad(F.lower(F.hex(size)), 8, "0"))


def dump_row(kind: Column, key: Column, term: Column) -> Column:
    return F.concat(kind.cast("string"), F.lit(":"), key, F.lit(":"), term.cast("string"))


def parse_ranges(text: str, first: int, last: int) -> list[tuple[int, int]]:
    """'a', 'a:b', ':b', 'a:', ':' and comma lists of them, within first..last."""
    out = []
    for part in text.split(","):
        a, colon, b = (x.strip() for x in part.partition(":"))
        lo = int(a) if a else first
        hi = (int(b) if b else last) if colon else lo
        if (not a and not colon) or lo < first or hi > last or lo > hi:
            raise ValueError(f"no range within {first}:{last}: {part!r}")
        out.append((lo, hi))
    return out


def in_ranges(index: Column, ranges: list[tuple[int, int]]) -> Column:
    cond = F.lit(False)
    for a, b in ranges:
        cond = cond | index.between(a, b)
    return cond


def snapshot_decision(log: DataFrame, snapshots: DataFrame, compact_only: bool = False) -> DataFrame:
    """snapshots(log_index, log_term) + decision: keep_tail where the log has that term at that index, else discard or reject."""
    terms = log.select(F.col("log_index").alias("_i"), F.col("term").alias("_t"))
    met = snapshots.join(terms, snapshots.log_index == F.col("_i"), "left")
    other = "reject" if compact_only else "discard"
    return met.select(*snapshots.columns, F.when(F.col("_t") == F.col("log_term"), "keep_tail").otherwise(other).alias("decision"))


def install_snapshot(log: DataFrame, index: int, term: int, compact_only: bool = False) -> DataFrame:
    """The log that is left after the snapshot (index, term): its tail, or nothing."""
    match = log.filter((F.col("log_index") == index) & (F.col("term") == term)).limit(1)
    if match.isEmpty():
        if compact_only:
            raise ValueError("the snapshot does not match the log")
        return log.filter(F.lit(False))
    return log.filter(F.col("log_index") > index)


def snapshot_chunks(size: int, chunk: int) -> list[tuple[int, int, bool, bool]]:
    """(byte_offset, length, first, last); an empty snapshot is one empty last chunk."""
    if size == 0:
        return [(0, 0, True, True)]
    return [(a, min(chunk, size - a), a == 0, a + chunk >= size) for a in range(0, size, chunk)]


def chunk_errors(chunks: DataFrame) -> DataFrame:
    """Chunks that do not follow the one before within their snapshot."""
    w = Window.partitionBy("log_index").orderBy("seq")
    want = F.coalesce(F.lag(F.col("byte_offset") + F.length("chunk")).over(w), F.lit(0))
    return chunks.withColumn("expected", want).filter(F.col("byte_offset") != F.col("expected"))
