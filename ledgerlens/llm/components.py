"""Connected components by alternating large-star and small-star rounds.

Every round is an aggregation and an equi-join; its edges are written to the shared folder,
so no lineage grows and lost executors only cost their own tasks. Edges never reach the
driver: only a count and a checksum do. Rows of a hub, a node that ends over one in ``SHARE`` of
the edges, are not gathered: there are at most 2 * SHARE hubs, whatever the graph, and their least
neighbours are sent to all tasks instead. Nothing else is, once there are over BROADCAST_ROWS edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, by_merge


SHARE = 200


def _with_least(rows: DataFrame, least: DataFrame, most: float, n: int) -> DataFrame:
    """rows(u, v) + m of least(u, m, d); nodes of more than ``most`` edges don't meet in one task."""
    hubs = F.broadcast(least.filter(F.col("d") > most).select("u", "m"))  # of at most 2 * SHARE rows
    rest = rows.join(hubs.select("u"), "u", "left_anti").join(by_merge(least.filter(F.col("d") <= most).select("u", "m"), n), "u")
    return rows.join(hubs, "u").select("u", "v", "m").union(rest.select("u", "v", "m"))


def _large_star(edges: DataFrame, most: float, n: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("d")).select("u", F.least("u", "m").alias("m"), "d")
    return _with_least(both.filter("v > u"), least, most, n).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, most: float, n: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("d"))
    moved = _with_least(edges, least, most, n).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """edges(u, v) of longs, in any direction -> (node, component), component the least node.

    Nodes without an edge are absent; self-loops and nulls are ignored; an empty input
    gives an empty table.
    """
    at = edges.filter("u is not null and v is not null and u <> v")
    at = at.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    at = scratch.save(at, "edges")
    mark, n = None, at.count()
    for _ in range(rounds):
        most = max(16, n / SHARE)
        nxt = scratch.save(_large_star(at, most, n).distinct(), "star")  # as many edges at most
        scratch.drop(at)
        at = scratch.save(_small_star(nxt, most, n).distinct(), "edges")
        scratch.drop(nxt)
        seen = at.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (seen.n, seen.h) == mark:
            break
        mark, n = (seen.n, seen.h), seen.n
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    roots = at.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return at.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
