"""Exact comparison inside cells of equal keys, with very large cells split into blocks.

Rows of a cell are compared in one task up to ``block`` rows. A larger cell is dealt into
g = ceil(rows / block) parts, and each of its g(g+1)/2 pairs of parts becomes a task unit
of its own, so every pair of rows still meets exactly once and no task holds a whole cell.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_merge


def dealt_cells(rows: DataFrame, key: str, member: str, block: int, parts: int | None = None) -> DataFrame:
    """rows + (unit_a, unit_b, side): cells of one row are dropped, large ones split.

    Output is hashed by (key, unit_a, unit_b) and sorted by it within partitions.
    """
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_size")).filter("_size > 1")
    met = rows.join(by_merge(sizes), key).withColumn("_g", F.ceil(F.col("_size") / F.lit(block)).cast("int"))
    met = met.withColumn("_s", F.when(F.col("_g") == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64(member), F.col("_g")).cast("int")))
    others = F.transform(F.sequence(F.lit(0), F.col("_g") - 1), lambda t: F.struct(F.least("_s", t).alias("a"), F.greatest("_s", t).alias("b")))
    met = met.withColumn("_u", F.explode(F.when(F.col("_g") == 1, F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))).otherwise(others)))
    met = met.select(*rows.columns, F.col("_u.a").alias("unit_a"), F.col("_u.b").alias("unit_b"), F.col("_s").alias("side"))
    spec = [key, "unit_a", "unit_b"]
    dealt = met.repartition(parts, *spec) if parts else met.repartition(*spec)
    return dealt.sortWithinPartitions(*spec)


def dealt_whole(rows: DataFrame, key: str, member: str, block: int, scratch) -> DataFrame:
    """As ``dealt_cells``, for rows that carry all that is compared: cells of one row stay.

    Rows are moved once, and their number is that of ``rows`` at every size of the corpus. Only
    the cells of over ``block`` rows are looked up, in a written table whose size the planner
    knows; where there are none, or few, it is sent to the tasks.
    """
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > block)
    hot = scratch.save(hot.select(F.col(key).alias("_hot"), F.ceil(F.col("_size") / F.lit(block)).cast("int").alias("_g")), "hot")
    met = rows.join(hot, F.col(key) == F.col("_hot"), "left")
    met = met.withColumn("_s", F.when(F.col("_g").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(member), F.col("_g")).cast("int")))
    pairs = F.transform(F.sequence(F.lit(0), F.coalesce("_g", F.lit(1)) - 1), lambda t: F.struct(F.least("_s", t).alias("a"), F.greatest("_s", t).alias("b")))
    met = met.withColumn("_u", F.explode(pairs))
    met = met.select(*rows.columns, F.col("_u.a").alias("unit_a"), F.col("_u.b").alias("unit_b"), F.col("_s").alias("side"))
    spec = [key, "unit_a", "unit_b"]
    return met.repartition(*spec).sortWithinPartitions(*spec)


def each_unit(batches: Iterator[pa.RecordBatch], key: str, work: Callable[[pa.Table], dict | None]) -> Iterator[pa.RecordBatch]:
    """Calls work with the rows of one (key, unit_a, unit_b) at a time, of sorted batches.

    Only the rows of the unit that a batch breaks off in are carried on: 2 blocks at most.
    """
    held: list[pa.RecordBatch] = []
    out: list[dict] = []

    def flush(table: pa.Table):
        got = work(table)
        if got is not None:
            out.append(got)

    def emit():
        if out:
            merged = {k: np.concatenate([x[k] for x in out]) for k in out[0]}
            out.clear()
            yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in merged.items()})

    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ks = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in (key, "unit_a", "unit_b")]
        change = np.zeros(n, bool)
        for c in ks:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in ks)
        change[0] = last is not None and first != last
        last = tuple(c[-1] for c in ks)
        cuts = np.flatnonzero(change)
        if not len(cuts):
            held.append(batch)
            continue
        if cuts[0] > 0:
            held.append(batch.slice(0, cuts[0]))
        if held:
            flush(pa.Table.from_batches(held))
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                flush(pa.Table.from_batches([batch.slice(a, b - a)]))
        held = [batch.slice(cuts[-1], n - cuts[-1])]
        yield from emit()
    if held:
        flush(pa.Table.from_batches(held))
    yield from emit()


def whole_units(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows of whole units, number of each row's unit within them), of sorted batches.

    The unit that a batch breaks off in is carried over: 2 blocks at most.
    """
    names = (key, "unit_a", "unit_b")
    held: list[pa.RecordBatch] = []
    for batch in itertools.chain(batches, [None]):
        if batch is None:
            table = pa.Table.from_batches(held) if held else None
        elif batch.num_rows:
            table = pa.Table.from_batches([*held, batch])
        else:
            continue
        if table is None:
            return
        change = np.zeros(table.num_rows, bool)
        for c in names:
            v = table[c].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        end = table.num_rows if batch is None else int(np.flatnonzero(change)[-1]) if change.any() else 0
        held = table.slice(end).to_batches()
        if end:
            yield table.slice(0, end), np.cumsum(change[:end])


def near_pairs(unit: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray], step: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of the same unit (numbers in order) that ``near`` accepts, some at a time.

    Rows are compared with those 1, 2, 3 ... places on, as long as any unit reaches so far.
    """
    n = len(unit)
    last = np.searchsorted(unit, unit, "right") - 1
    out_a, out_b = [], []
    at, d = np.flatnonzero(last > np.arange(n)), 1
    while len(at):
        for k in range(0, len(at), step):
            i = at[k : k + step]
            ok = near(i, i + d)
            out_a.append(i[ok])
            out_b.append(i[ok] + d)
        if sum(map(len, out_a)) > 2 * step:  # a forest holds the same links
            label = forest(n, np.concatenate(out_a), np.concatenate(out_b))
            moved = np.flatnonzero(label != np.arange(n))
            out_a, out_b = [moved], [label[moved]]
        d += 1
        at = at[at + d <= last[at]]
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (np.empty(0, np.int64), np.empty(0, np.int64))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Label of each of n nodes: the least index reachable over the edges a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        nxt = label.copy()
        np.minimum.at(nxt, a, low)
        np.minimum.at(nxt, b, low)
        np.minimum.at(nxt, label[a], low)
        np.minimum.at(nxt, label[b], low)
        nxt = nxt[nxt]
        if (nxt == label).all():
            return label
        label = nxt
