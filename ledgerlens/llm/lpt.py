"""Sharding by longest-processing-time scheduling over groups that stay together.

Rows of equal text are one group; its size is the sum of its rows' sizes (UTF-8 bytes of
the text, null counting as none, plus 1). Groups go, largest first, to the least loaded
shard, which a heap gives.

So that no driver holds all groups, they are counted by size class (sizes under 4096 are
classes of their own, larger ones share the top 12 bits: at most 4096 + 2048 per doubling
classes, whatever the number of rows). The heap hands out whole classes: while more groups
than a few a shard are left, each shard gets as many as bring it to a common level, which is
what the heap gives one by one; the rest goes one by one. A group finds its shard by its
rank within its class.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, with_rank


def lpt_counts(classes: list[tuple[int, int, float]], shards: int) -> list[tuple[int, list[int]]]:
    """(class, groups, mean size) in any order -> (class, groups of it for each shard)."""
    heap = [(0.0, k) for k in range(shards)]
    out = []
    for cls, left, size in sorted(classes, key=lambda c: -c[0]):
        got = [0] * shards
        if left > 4 * shards and size > 0:
            loads = sorted(heap)
            given = left - shards
            total, k = 0.0, 0
            while k < shards and (k == 0 or loads[k][0] * k - total < given * size):
                total += loads[k][0]
                k += 1
            level = (total + given * size) / k
            heap = []
            for load, s in loads:
                n = min(left, max(0, int((level - load) / size)))
                got[s] += n
                left -= n
                heap.append((load + n * size, s))
            heapq.heapify(heap)
        while left:
            load, s = heap[0]
            heapq.heapreplace(heap, (load + size, s))
            got[s] += 1
            left -= 1
        out.append((cls, got))
    return out


def size_class(size):
    drop = F.greatest(F.length(F.bin(size)) - 12, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", size, drop), drop).cast("long")


def assign_groups(groups: DataFrame, shards: int) -> DataFrame:
    """groups(key, size) -> (key, shard)."""
    spark = groups.sparkSession
    classed = groups.withColumn("cls", size_class(F.col("size")))
    counted = classed.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total")).collect()
    plan = []
    for cls, got in lpt_counts([(r.cls, r.n, r.total / r.n) for r in counted], shards):
        ends, at = [], 0
        for n in got:
            at += n
            ends.append(at)
        plan.append((cls, ends))
    plan_df = spark.createDataFrame(plan, "cls long, ends array<long>")
    ranked = with_rank(classed, ["cls"], [F.col("key")], "rank")
    # the plan has a row for each size class: at most a few ten thousand
    met = ranked.join(F.broadcast(plan_df), "cls")
    return met.select("key", F.size(F.filter("ends", lambda e: e <= F.col("rank"))).cast("int").alias("shard"))


def shard_documents(docs: DataFrame, shards: int = 16, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row; slot is gapless from 0 in a shard.

    Null texts are grouped with empty ones (size 1, crc 0); repeated rows are rows of their
    own in one group; a null doc_id is kept; an empty table gives an empty result; other
    columns are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession, "lpt")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = scratch.save(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("key")), "rows")
    groups = rows.groupBy("key").agg(F.sum("size").alias("size"))
    placed = rows.join(assign_groups(groups, shards), "key")
    return with_rank(placed.select("doc_id", "size", "text_crc32", "shard"), ["shard"], [F.col("doc_id"), F.col("text_crc32")], "slot", salts=1024)
