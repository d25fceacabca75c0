"""Replaying a log: state machines as ordered folds, snapshots plus tails, and compaction.

Folds that commute or keep the last value belong in SQL (``operators.log.fold_last``). An
ordered fold is serial by nature: keyed ones run a key in a task; one without a key goes
through the log segment by segment on the driver, which holds one segment at a time.
"""

from __future__ import annotations

import zlib
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import codec


class ReplayError(ValueError):
    """Entries that do not continue what has been applied."""


class StateFold(Protocol):
    """A state machine: entries in order, from what was applied last, after a snapshot if one is due."""

    last_applied: int

    def apply(self, entries: list[tuple[int, int, bytes]], next_index: int, term: int, snapshot: tuple[int, int, bytes] | None = None) -> int: ...

    def serialize(self) -> bytes: ...


class PassThrough:
    """Keeps the payloads of STATE entries one after another, compressed if asked."""

    def __init__(self, compress: bool = False):
        self.parts: list[bytes] = []
        self.last_applied, self.compress = 0, compress

    def apply(self, entries, next_index, term, snapshot=None):
        if snapshot is not None:
            self.parts = [zlib.decompress(snapshot[2], 31) if self.compress else snapshot[2]]
            self.last_applied = snapshot[0]
        if next_index != self.last_applied + 1:
            raise ReplayError(f"entries from {next_index} do not follow {self.last_applied}")
        self.parts += [data for kind, _, data in entries if kind == codec.STATE]
        self.last_applied += len(entries)
        return self.last_applied

    def serialize(self):
        raw = b"".join(self.parts)
        if not self.compress:
            return raw
        z = zlib.compressobj(9, zlib.DEFLATED, 31)
        return z.compress(raw) + z.flush()


def feed(machine: StateFold, log: DataFrame, snapshot: tuple[int, int, bytes] | None = None, upto: int | None = None, term: int = 0, step: int = 16384) -> int:
    """Applies what the machine lacks up to an index; nothing if it has it all.

    Raises where neither the snapshot nor the log reaches back to the machine's state.
    """
    b = log.agg(F.min("log_index").alias("a"), F.max("log_index").alias("b")).first()
    first, last = (b.a, b.b) if b.a is not None else ((snapshot[0] + 1, snapshot[0]) if snapshot else (1, 0))
    upto = last if upto is None else upto
    if upto > last:
        raise ReplayError(f"the log ends at {last}")
    if machine.last_applied >= upto:
        return machine.last_applied
    start = machine.last_applied + 1
    if start < first:
        if snapshot is None or snapshot[0] != first - 1:
            raise ReplayError(f"neither log nor snapshot reaches back to {start}")
        machine.apply([], snapshot[0] + 1, term, snapshot)
        start = snapshot[0] + 1
    while start <= upto:
        end = min(upto, start + step - 1)
        rows = log.filter(F.col("log_index").between(start, end)).select("log_index", "entry_type", "term", "data").orderBy("log_index").collect()
        machine.apply([(r.entry_type, r.term, bytes(r.data)) for r in rows], start, term)
        start = end + 1
    return machine.last_applied


def fold_by_key(log: DataFrame, keys: list[str], fold, schema: str) -> DataFrame:
    """An ordered fold for each key: fold(rows in log order) -> rows of ``schema``. A key is one task's."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return fold(pdf.sort_values("log_index"))

    return log.groupBy(*keys).applyInPandas(run, schema)


def snapshot_and_tail(snapshot: DataFrame, tail: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Last values by key of a snapshot's (keys, log_index, value) and the entries after it."""
    from .log import fold_last

    return fold_last(snapshot.select(*keys, "log_index", value).unionByName(tail.select(*keys, "log_index", value)), keys, value)


def prunable(segments: DataFrame, compaction_index: int) -> DataFrame:
    """Segments that lie before the one that holds the compaction index."""
    holder = segments.filter(F.col("segment_first_index") <= compaction_index).agg(F.max("segment_first_index").alias("_h"))
    return segments.join(F.broadcast(holder), F.col("segment_first_index") < F.col("_h")).drop("_h")
