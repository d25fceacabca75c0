"""Embedding near-dedup by iterative quantisation and multi-index Hamming tables.

Training, on a bounded sample: principal axes, then rotations that alternate between signs and
the orthogonal fit to them, so that bits are balanced and close to the vectors. Every vector
gets a code of ``tables`` substrings of ``width`` bits; a table holds one of them, and vectors
of a label whose substrings are equal meet there. The width is the logarithm of the number of vectors
of the largest label, and there are as many tables as give a pair at the threshold a
chance of RECALL to meet: its bits differ with probability angle / pi. Pairs that meet are held against
each other by their whole codes, and only vectors with a partner near enough (four deviations
beyond the mean at the threshold) are fetched, to be ranked again in double precision;
only cosines of at least the threshold are links. A pair counts in the first table in which it meets.

Equal vectors of a label are one class with its number of rows, so copies are never paired.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import dealt_whole, each_unit, forest, near_pairs, whole_units
from .common import Scratch
from .components import connected_components

SAMPLE = 20_000
RECALL = 0.97
MIN_WIDTH, MAX_WIDTH = 10, 24
BLOCK = 2048


def plan_tables(largest: int, threshold: float, recall: float = RECALL) -> tuple[int, int, int]:
    """(tables, width, radius): substrings, their bits, and the bits that linked codes differ in at most."""
    width = min(MAX_WIDTH, max(MIN_WIDTH, round(math.log2(max(1, largest)))))
    share = math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    meet = min((1 - share) ** width, 1 - 1e-9)
    tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))
    bits = tables * width
    return tables, width, math.ceil(bits * share + 4 * (bits * share * (1 - share)) ** 0.5)


class Coder:
    """bits = signs of (x / |x| - mean) @ axes."""

    def __init__(self, sample: np.ndarray, bits: int, rounds: int = 50, seed: int = 5):
        self.dims = sample.shape[1] if sample.ndim == 2 else 0
        rng = np.random.default_rng(seed)
        if not len(sample):
            self.mean, self.axes = np.zeros(self.dims), np.zeros((self.dims, bits))
            return
        x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.mean = x.mean(0)
        x = x - self.mean
        _, _, main = np.linalg.svd(x.T @ x)
        axes = []
        for start in range(0, bits, self.dims):  # fewer dimensions than bits: further rotations
            n = min(self.dims, bits - start)
            v = x @ main[:n].T
            turn, _ = np.linalg.qr(rng.standard_normal((n, n)))
            for _ in range(rounds):
                u, _, w = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
                turn = (u @ w).T
            axes.append(main[:n].T @ turn)
        self.axes = np.concatenate(axes, axis=1)

    def bits(self, x: np.ndarray) -> np.ndarray:
        return (x / np.linalg.norm(x, axis=1, keepdims=True) - self.mean) @ self.axes >= 0


def usable(vectors: DataFrame, id_col: str, vec: str, label: str) -> DataFrame:
    """(vec_id, label, e, node) for every row; node names the label and vector, null where it can't link."""
    e = F.col(vec)
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(e, lambda x: x != 0)
    ok = F.col(label).isNotNull() & F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label).alias("label"), e.alias("e"), F.when(ok, F.xxhash64(label, e)).alias("node"))


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(flat)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _packed(bits: np.ndarray) -> np.ndarray:
    """n x k numbers of 64 bits."""
    n, m = bits.shape
    full = np.zeros((n, -(-m // 64) * 64), bool)
    full[:, :m] = bits
    return np.packbits(full, axis=1).view(">u8").astype(np.uint64)


def _cell_keys(bits: np.ndarray, label_hash: np.ndarray, tables: int, width: int) -> np.ndarray:
    """n x tables keys: the label, the table and its substring mixed."""
    sub = bits.reshape(len(bits), tables, width) @ (np.uint64(1) << np.arange(width, dtype=np.uint64))
    k = sub | (np.arange(tables, dtype=np.uint64) << np.uint64(32))
    k = (k ^ label_hash[:, None]) * np.uint64(0x9E3779B97F4A7C15)
    k ^= k >> np.uint64(29)
    return k * np.uint64(0xBF58476D1CE4E5B9)


def _first_table(diff: np.ndarray, tables: int, width: int) -> np.ndarray:
    """The first table in which codes with this difference (n x k numbers) meet."""
    out = np.empty(len(diff), np.int64)
    for at in range(0, len(diff), 1 << 15):
        d = diff[at : at + (1 << 15)]
        bits = np.unpackbits(d.astype(">u8").view(np.uint8).reshape(len(d), 8 * diff.shape[1]), axis=1)[:, : tables * width]
        out[at : at + len(d)] = (~bits.reshape(len(d), tables, width).any(2)).argmax(1)
    return out


def vector_groups(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec: str = "embedding", label: str = "label", recall: float = RECALL, sample: int = SAMPLE, scratch: Scratch | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Vectors that are null, zero or hold null or non-finite components, and rows with a null
    label or id, link with nothing. Vectors of another length than most of the sample's
    link with nothing but their copies. Rows that repeat an id are vectors of their own; an empty
    table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "itq")
    rows = usable(vectors, id_col, vec, label)
    classes = rows.filter("node is not null").groupBy("node").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("e").alias("e"))
    classes = scratch.save(classes, "classes")
    largest = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first().n or 1
    tables, width, radius = plan_tables(largest, threshold, recall)
    drawn = classes.select("e").orderBy(F.xxhash64("node")).limit(sample).toPandas()["e"]  # of at most ``sample`` rows
    sizes = drawn.map(len)
    dims = int(sizes.mode().iloc[0]) if len(sizes) else 1
    coder = Coder(np.array([x for x in drawn if len(x) == dims], np.float64).reshape(-1, dims), tables * width)
    parts = [f"c{k}" for k in range(-(-tables * width // 64))]

    def encode(batches):
        for b in batches:
            if b.num_rows:
                bits = coder.bits(_matrix(b.column(1)))
                keys = _cell_keys(bits, b.column(2).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), tables, width).view(np.int64)
                codes = _packed(bits).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables), pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(codes[:, k])) for k in range(len(parts))), lists], ["node", *parts, "cells"])

    same = classes.filter(F.size("e") == dims)
    coded = same.select("node", "e", F.xxhash64("label").alias("h")).mapInArrow(encode, f"node long, {', '.join(f'{c} long' for c in parts)}, cells array<long>")
    coded = scratch.save(coded, "codes")
    placed = coded.select("node", *parts, F.posexplode("cells").alias("place", "cell"))
    met = dealt_whole(placed, "cell", "node", BLOCK, scratch)

    def owned(x, place, i, j):
        """Of pairs within the radius, those that meet here first."""
        ok = np.bitwise_count(x[i] ^ x[j]).sum(1, dtype=np.int32) <= radius
        at = np.flatnonzero(ok)
        ok[at] = _first_table(x[i[at]] ^ x[j[at]], tables, width) == place[i[at]]
        return ok

    def partners(batches):
        """The rows with a partner, for a second look with their vectors."""
        for table, unit in whole_units(batches, "cell"):
            x = np.stack([table[c].to_numpy().view(np.uint64) for c in parts], axis=1)
            place, side = table["place"].to_numpy(), table["side"].to_numpy()
            cross = table["unit_a"].to_numpy() != table["unit_b"].to_numpy()
            has = np.zeros(len(x), bool)

            def near(i, j):
                ok = ~(cross[i] & (side[i] == side[j])) & ~(has[i] & has[j])
                at = np.flatnonzero(ok)
                ok[at] = owned(x, place, i[at], j[at])
                has[i[ok]] = has[j[ok]] = True
                return np.zeros(len(i), bool)

            near_pairs(unit, near)
            if has.any():
                kept = table.filter(pa.array(has)).select(["node", *parts, "place", "cell", "unit_a", "unit_b", "side"]).combine_chunks()
                yield from kept.to_batches()

    shape = f"node long, {', '.join(f'{c} long' for c in parts)}, place int, cell long, unit_a int, unit_b int, side int"
    close = scratch.save(met.mapInArrow(partners, shape), "close")
    close = close.join(same.select("node", "e", "copies"), "node").repartition("cell", "unit_a", "unit_b").sortWithinPartitions("cell", "unit_a", "unit_b")

    def compare(t: pa.Table) -> dict | None:
        v = _matrix(t["e"])
        v = v / np.linalg.norm(v, axis=1, keepdims=True)
        x = np.stack([t[c].to_numpy().view(np.uint64) for c in parts], axis=1)
        node, place, copies, side = t["node"].to_numpy(), t["place"].to_numpy(), t["copies"].to_numpy(), t["side"].to_numpy()
        cross = t["unit_a"][0] != t["unit_b"][0]
        n = len(v)
        count = np.zeros(n, np.int64)
        a_all, b_all = [], []
        for at in range(0, n, 512):
            hi = min(n, at + 512)
            near = np.triu(v[at:hi] @ v[at:].T >= threshold - 1e-9, 1)
            if cross:
                near &= side[at:hi, None] != side[None, at:]
            i, j = np.nonzero(near)
            i, j = i + at, j + at
            mine = np.einsum("ij,ij->i", v[i], v[j]) >= threshold
            mine[mine] = owned(x, place, i[mine], j[mine])
            i, j = i[mine], j[mine]
            np.add.at(count, i, copies[j])
            np.add.at(count, j, copies[i])
            if len(i):
                root = forest(n, i, j)
                moved = np.flatnonzero(root != np.arange(n))
                a_all.append(moved)
                b_all.append(root[moved])
        if not a_all:
            return None
        root = forest(n, np.concatenate(a_all), np.concatenate(b_all))
        on = np.flatnonzero(count)
        return {"node": node[on], "to": node[root[on]], "n": count[on]}

    links = scratch.save(close.mapInArrow(lambda bs: each_unit(bs, "cell", compare), "node long, to long, n long"), "links")
    comps = connected_components(links.select(F.col("node").alias("u"), F.col("to").alias("v")), scratch).withColumnRenamed("component", "root")
    counts = links.groupBy("node").agg(F.sum("n").alias("n"))
    info = classes.select("node", "rep", "copies").join(counts, "node", "left").join(comps, "node", "left")
    info = scratch.save(info.select("node", "rep", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")), "info")
    least = info.groupBy("root").agg(F.min("rep").alias("component_id"))
    known = info.join(least, "root").select("node", "n_links", "component_id")
    out = rows.select("vec_id", "node").join(known, "node", "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), (F.col("vec_id") == own).alias("kept"))
