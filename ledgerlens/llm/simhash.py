"""SimHash near-duplicates through a table of distances to pivot fingerprints.

A document's words are runs of anything but ASCII white space, A-Z lower-cased; every
shingle of ``shingle`` words (repeats included) is hashed with XXH64, seed 42, and a bit of
the fingerprint is 1 if it is set in over half the hashes.

Search. Each distinct fingerprint gets its row of the pivot table: Hamming distances to
``pivots`` reference fingerprints. By the triangle inequality two fingerprints within r bits
differ by at most r in every coordinate, so a pair with a larger coordinate difference is
discarded unseen, and only survivors are verified bit by bit. Pivots alone leave a share of
all pairs, which grows with the square of the corpus; the pairs they are asked about are
therefore those that agree on ``clean`` of ``segments`` bit segments, which r flipped bits
can't prevent (segments - clean = r). Both steps are exact: no link is lost.

Within a cell only the links of a spanning forest are given on, never all pairs, and a cell
of over ``BLOCK`` fingerprints is split into blocks compared in tasks of their own.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import dealt_cells, dealt_whole, each_unit, forest, near_pairs, whole_units
from .common import Scratch, by_merge
from .components import connected_components

SEED = 42
BLOCK = 4096
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.translate(_LOWER) if not text.isascii() else text.lower()) if text else []


def text_fingerprint(text: str | None, shingle: int = 4) -> int:
    """The unsigned 64-bit fingerprint; 0 where the text is null or has no word."""
    return fingerprint_of(words_of(text), shingle)


def fingerprint_of(words: list[str], shingle: int) -> int:
    n = len(words) - shingle + 1
    if not words:
        return 0
    if n <= 1:
        return xxhash.xxh64_intdigest(" ".join(words), seed=SEED)
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    columns = [words[i:] for i in range(1, shingle)]
    shingles = map(" ".join, zip(words, *columns))
    step = 1 << 16
    done = 0
    while done < n:
        m = min(step, n - done)
        hashes = np.fromiter((digest(next(shingles), SEED) for _ in range(m)), ">u8", m)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        done += m
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's bits as a signed long."""
    ids = docs.schema["doc_id"].dataType

    def work(batches):
        for b in batches:
            fps = np.array([text_fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(work, f"doc_id {ids.simpleString()}, fp long")


def pivot_fingerprints(pivots: int) -> list[int]:
    """Reference fingerprints: fixed pseudo-random 64-bit codes, as signed longs."""
    return [int(np.uint64(xxhash.xxh64_intdigest(f"pivot {i}", seed=SEED)).astype(np.int64)) for i in range(pivots)]


def segment_bounds(segments: int) -> list[tuple[int, int]]:
    cuts = [round(i * 64 / segments) for i in range(segments + 1)]
    return list(zip(cuts, cuts[1:]))


def cell_keys(fp, segments: int, clean: int):
    """One long per choice of ``clean`` segments: a hash of the choice and their bits."""
    keys = []
    for k, chosen in enumerate(combinations(segment_bounds(segments), clean)):
        mask = 0
        for a, b in chosen:
            mask |= ((1 << (b - a)) - 1) << a
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.lit(k), fp.bitwiseAND(F.lit(signed))))
    return F.array(*keys)


def _compare(table: pa.Table, radius: int, step: int = 512) -> dict | None:
    """Links of one unit as (member, least member of its part of the forest)."""
    fp = table["fp"].to_numpy().view(np.uint64)
    rep = table["rep"].to_numpy()
    pivot = np.frombuffer(b"".join(x.as_py() for x in table["pivot"]), np.uint8).reshape(len(fp), -1).astype(np.int16)
    side = table["side"].to_numpy()
    cross = table["unit_a"][0] != table["unit_b"][0]
    order = np.lexsort((fp, pivot[:, 0]))
    fp, rep, pivot, side = fp[order], rep[order], pivot[order], side[order]
    n = len(fp)
    end = np.searchsorted(pivot[:, 0], pivot[:, 0] + radius, "right")
    links = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for at in range(0, n, step):
        hi, to = min(n, at + step), int(end[min(n, at + step) - 1])
        near = np.triu(np.ones((hi - at, to - at), bool), 1)
        for p in range(pivot.shape[1]):
            near &= np.abs(pivot[at:hi, None, p] - pivot[None, at:to, p]) <= radius
        if cross:
            near &= side[at:hi, None] != side[None, at:to]
        i, j = np.nonzero(near)
        ok = np.bitwise_count(fp[at + i] ^ fp[at + j]) <= radius
        links.append((at + i[ok], at + j[ok]))
        if sum(len(x) for x, _ in links) > 4_000_000:
            label = forest(n, *(np.concatenate(x) for x in zip(*links)))
            moved = np.flatnonzero(label != np.arange(n))
            links = [(moved, label[moved])]
    a, b = (np.concatenate(x) for x in zip(*links))
    if not len(a):
        return None
    label = forest(n, a, b)
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, label, rep)
    moved = np.flatnonzero(least[label] != rep)
    return {"u": rep[moved], "v": least[label[moved]]}


def simhash_links(classes: DataFrame, radius: int = 4, segments: int = 7, pivots: int = 16) -> DataFrame:
    """classes(fp, rep): distinct fingerprints -> forest edges (u, v) of reps of linked ones."""
    coords = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))) for p in pivot_fingerprints(pivots)]
    packed = F.unhex(F.concat(*[F.lpad(F.hex(c), 2, "0") for c in coords]))
    keyed = classes.filter("rep is not null").select("fp", "rep", F.explode(cell_keys(F.col("fp"), segments, segments - radius)).alias("cell"))
    dealt = dealt_cells(keyed, "cell", "fp", BLOCK).withColumn("pivot", packed)

    def work(batches):
        yield from each_unit(batches, "cell", lambda t: _compare(t, radius))

    return dealt.mapInArrow(work, "u long, v long")


def simhash_groups(docs: DataFrame, shingle: int = 4, radius: int = 4, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id reachable over links.

    doc_id is a whole number or names one (it is cast to long). Null or empty texts have
    fingerprint 0 and link like any other; repeated rows each get a row; rows without doc_id get
    the component of their fingerprint; an empty table gives an empty result. Other columns of
    docs are ignored.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "simhash")
    prints = scratch.save(fingerprints(docs, shingle), "prints")
    classes = scratch.save(prints.groupBy("fp").agg(F.min("doc_id").cast("long").alias("rep")), "classes")
    comps = connected_components(simhash_links(classes, radius), scratch)
    named = classes.join(by_merge(comps), classes.rep == comps.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(by_merge(named), "fp").select("doc_id", "fp", "component_id")


# Wide fingerprints: the same search for texts that share most of their shingles. 64 bits hold
# too little for that: texts of Jaccard 0.8 differ in 9 of them on average, and unrelated texts
# of a large corpus come as close by chance. LANES x 64 bits tell both apart.

LANES = 4
BANDS, BAND_ROWS = 24, 5
VERIFY_BLOCK = 512


def wide_radius(similarity: float, lanes: int = LANES) -> int:
    """Bits in which texts of that Jaccard similarity differ, with four deviations to spare."""
    cosine = 2 * similarity / (1 + similarity)
    share = float(np.arccos(cosine) / np.pi)
    bits = 64 * lanes
    return int(bits * share + 4 * (bits * share * (1 - share)) ** 0.5)


def _lanes(h: np.ndarray, lanes: int) -> np.ndarray:
    """n x lanes hashes from n: splitmix steps of the first."""
    out = np.empty((len(h), lanes), np.uint64)
    out[:, 0] = h
    for k in range(1, lanes):
        x = h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = x ^ (x >> np.uint64(31))
    return out


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted hashes of the different shingles; no word: a single 0."""
    return shingles_of(words_of(text), shingle)


def shingles_of(words: list[str], shingle: int) -> np.ndarray:
    if not words:
        return np.zeros(1, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(" ".join(words), SEED)], np.uint64)
    seen = {digest(s, SEED) for s in map(" ".join, zip(*(words[i:] for i in range(shingle))))}
    return np.sort(np.fromiter(seen, np.uint64, len(seen)))


def _wide_bits(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """lanes numbers of 64 bits; each shingle counts once, as in the Jaccard similarity."""
    ones = np.zeros(64 * lanes, np.int64)
    for a in range(0, len(hashes), 1 << 14):
        part = _lanes(hashes[a : a + (1 << 14)], lanes).astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8 * lanes), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).view(">u8").astype(np.uint64)


def _band_keys(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One number for each band of ``rows`` least hashes, each under an order of its own."""
    rng = np.random.default_rng(SEED)
    flip = rng.integers(0, 1 << 63, bands * rows, np.uint64)
    odd = rng.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), 1 << 12):
        np.minimum(least, ((hashes[a : a + (1 << 12), None] ^ flip) * odd).min(0), out=least)
    least, k = least.reshape(bands, rows), np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        k = (k ^ least[:, r]) * np.uint64(0x9E3779B97F4A7C15)
        k ^= k >> np.uint64(29)
    return k * np.uint64(0xBF58476D1CE4E5B9)


def _verify(table: pa.Table, shingle: int, similarity: float) -> dict | None:
    """Links (u, v) that connect the texts of one unit as their exact Jaccard similarities do.

    Each text is held against the later ones that it isn't connected with yet. Sizes and, as
    1 - Jaccard is a metric, distances to earlier texts discard; shared shingles verify.
    """
    rep, side = table["rep"].to_numpy(), table["side"].to_numpy()
    cross = table["unit_a"][0] != table["unit_b"][0]
    sets = [shingle_set(x.as_py(), shingle) for x in table["text"]]
    n, size = len(sets), np.array([len(x) for x in sets])
    label, known = np.arange(n), []
    u, v = [], []
    for h in range(n - 1):
        todo = np.zeros(n, bool)
        todo[h + 1 :] = np.minimum(size[h], size[h + 1 :]) >= similarity * np.maximum(size[h], size[h + 1 :]) - 1e-9
        if cross:
            todo &= side != side[h]
        for far in known:
            todo &= ~(np.abs(far - far[h]) > 1 - similarity + 1e-9)
        far = np.full(n, np.nan)
        far[h] = 0
        for first in (True, False):  # one of each part, then the rest of the parts still apart
            at = np.flatnonzero(todo & (label != label[h]))
            if first and len(at):
                at = at[np.unique(label[at], return_index=True)[1]]
            todo[at] = False
            for a in range(0, len(at), 64):
                some = at[a : a + 64]
                held = np.concatenate([sets[x] for x in some])
                found = sets[h][np.minimum(np.searchsorted(sets[h], held), size[h] - 1)] == held
                both = np.add.reduceat(found.astype(np.int64), np.concatenate([[0], np.cumsum(size[some])[:-1]]))
                far[some] = 1 - both / (size[h] + size[some] - both)
            for x in at[far[at] <= 1 - similarity + 1e-9]:
                if label[x] != label[h]:
                    label[label == label[x]] = label[h]
                    u.append(rep[x])
                    v.append(rep[h])
        if len(known) < 16 and np.isfinite(far).sum() > 2:
            known.append(far)
    return {"u": np.array(u, np.int64), "v": np.array(v, np.int64)} if u else None


def wide_prints(docs: DataFrame, shingle: int, lanes: int = LANES, bands: int = BANDS, rows: int = BAND_ROWS, narrow: int = 4) -> DataFrame:
    """(doc_id, fp, key, f0 ..., cells): both fingerprints of a text, a digest of its shingle set, and its bands.

    fp is that of ``narrow``-word shingles, as ``fingerprints`` has it.
    """
    ids = docs.schema["doc_id"].dataType.simpleString()
    parts = [f"f{k}" for k in range(lanes)]

    def work(batches):
        for b in batches:
            n = b.num_rows
            keys, fps, wide, cells = [], np.empty(n, np.uint64), np.empty((n, lanes), np.uint64), np.empty((n, bands), np.uint64)
            for i, t in enumerate(b.column(1)):
                words = words_of(t.as_py())
                hashes = shingles_of(words, shingle)
                keys.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                fps[i], wide[i], cells[i] = fingerprint_of(words, narrow), _wide_bits(hashes, lanes), _band_keys(hashes, bands, rows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, cells.size + 1, bands), pa.int32()), pa.array(cells.view(np.int64).ravel()))
            lanes_of = (pa.array(np.ascontiguousarray(wide[:, k]).view(np.int64)) for k in range(lanes))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), pa.array(keys, pa.binary()), *lanes_of, lists], ["doc_id", "fp", "key", *parts, "cells"])

    kinds = f"doc_id {ids}, fp long, key binary, {', '.join(f'{c} long' for c in parts)}, cells array<long>"
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(work, kinds)


def wide_links(docs: DataFrame, classes: DataFrame, shingle: int, similarity: float, scratch: Scratch, lanes: int = LANES) -> DataFrame:
    """Edges (u, v) that connect the reps of classes(key, rep, f0 ..., cells) as links of that Jaccard similarity do.

    Candidates agree on a band of least hashes and lie within ``wide_radius(similarity)`` bits.
    Both only make groups, in which every pair that may still be linked is verified by its shingles.
    """
    radius = wide_radius(similarity, lanes)
    parts = [f"f{k}" for k in range(lanes)]
    pivots = np.array([[xxhash.xxh64_intdigest(f"pivot {i} {k}", seed=SEED) for k in range(lanes)] for i in range(8)], np.uint64)
    keyed = classes.filter("rep is not null").select("rep", *parts, F.explode("cells").alias("cell"))
    met = dealt_whole(keyed, "cell", "rep", BLOCK, scratch)

    def links(batches):
        for table, unit in whole_units(batches, "cell"):
            x = np.stack([table[c].to_numpy().view(np.uint64) for c in parts], axis=1)
            rep, side = table["rep"].to_numpy(), table["side"].to_numpy()
            cross = table["unit_a"].to_numpy() != table["unit_b"].to_numpy()
            to_pivot = np.stack([np.bitwise_count(x ^ p).sum(1, dtype=np.int16) for p in pivots], axis=1)

            def near(i, j):
                ok = ~(cross[i] & (side[i] == side[j]))
                ok &= (np.abs(to_pivot[i] - to_pivot[j]) <= radius).all(1)
                at = np.flatnonzero(ok)
                ok[at] = np.bitwise_count(x[i[at]] ^ x[j[at]]).sum(1, dtype=np.int32) <= radius
                return ok

            i, j = near_pairs(unit, near)
            if len(i):
                label = forest(len(x), i, j)
                moved = np.flatnonzero(label != np.arange(len(x)))
                yield pa.RecordBatch.from_arrays([pa.array(rep[moved]), pa.array(rep[label[moved]])], ["u", "v"])

    groups = scratch.save(connected_components(met.mapInArrow(links, "u long, v long"), scratch), "groups")
    groups = by_merge(groups, groups.count())
    held = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text")).join(groups, "node")
    held = held.select(F.col("node").alias("rep"), "component", "text")
    held = dealt_cells(scratch.save(held, "held"), "component", "rep", VERIFY_BLOCK)
    return scratch.save(held.mapInArrow(lambda batches: each_unit(batches, "component", lambda t: _verify(t, shingle, similarity)), "u long, v long"), "exact")


def _wide_classes(made: DataFrame, lanes: int = LANES) -> DataFrame:
    return made.groupBy("key").agg(F.min("doc_id").cast("long").alias("rep"), *(F.first(c).alias(c) for c in (*(f"f{k}" for k in range(lanes)), "cells")))


def wide_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, component_id) over links of texts whose shingle sets have that Jaccard similarity.

    At Jaccard 0.8 all pairs but one in ten thousand are candidates. doc_id is cast to long.
    Null and empty texts are alike; repeated rows each get a row; rows without doc_id get the
    component of their shingle set; an empty table gives an empty result; other columns are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession, "wide")
    made = scratch.save(wide_prints(docs, shingle), "prints")
    classes = scratch.save(_wide_classes(made), "classes")
    comps = connected_components(wide_links(docs, classes, shingle, similarity, scratch), scratch)
    named = classes.join(by_merge(comps), classes.rep == comps.node, "left").select("key", F.coalesce("component", "rep").alias("component_id"))
    return made.join(by_merge(named), "key").select("doc_id", "component_id")


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def without_copies(docs: DataFrame, copies: DataFrame, scratch: Scratch) -> DataFrame:
    """docs without the rows whose doc_id is in copies(doc_id), one row for each doc_id.

    Of rows that repeat a doc_id any one stays. Rows without doc_id stay.
    """
    twice = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("doc_id")
    twice = scratch.save(twice, "twice")
    n = twice.count()
    twice = by_merge(twice, n)
    kept = docs.join(by_merge(copies, copies.count()), "doc_id", "left_anti")
    if not n:
        return kept.select(*docs.columns)
    return kept.join(twice, "doc_id", "left_anti").select(*docs.columns).union(kept.join(twice, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"]))


def _copies(edges: DataFrame, ids: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id) of all but the least document of each component; doc_id as in ids."""
    comps = connected_components(edges, scratch)
    kind = ids.schema["doc_id"].dataType
    return scratch.save(comps.filter("node <> component").select(F.col("node").cast(kind).alias("doc_id")), "copies")


def _members(made: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """Edges from every document to the rep of its class."""
    return made.select(F.col("doc_id").cast("long").alias("u"), key).join(by_merge(classes.select(key, F.col("rep").alias("v"))), key).select("u", "v")


def simhash_dedup(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """One document of each group of ``simhash_groups``, that with the least doc_id; odd rows as in ``near_copy_dedup``."""
    scratch = Scratch(docs.sparkSession, "simhash")
    made = scratch.save(fingerprints(docs.select("doc_id", "text"), shingle), "prints")
    classes = scratch.save(made.groupBy("fp").agg(F.min("doc_id").cast("long").alias("rep")), "classes")
    return without_copies(docs, _copies(_members(made, classes, "fp").union(simhash_links(classes, radius)), docs, scratch), scratch)


def near_copy_dedup(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 4) -> DataFrame:
    """One document of each group that links of either kind make, that with the least doc_id: fingerprints
    of 4-word shingles within ``radius`` bits, shingle sets of ``shingle`` words of Jaccard ``similarity``.

    Null and empty texts are alike and copies of each other; of rows that repeat a doc_id one stays;
    rows without doc_id stay; an empty table gives an empty result; other columns, whatever
    their names, are handed on.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    texts = docs.select("doc_id", "text")
    made = scratch.save(wide_prints(texts, shingle, narrow=4), "prints")
    wide = scratch.save(_wide_classes(made), "wide")
    narrow = scratch.save(made.groupBy("fp").agg(F.min("doc_id").cast("long").alias("rep")), "narrow")
    edges = _members(made, wide, "key").union(_members(made, narrow, "fp")).union(simhash_links(narrow, radius)).union(wide_links(texts, wide, shingle, similarity, scratch))
    return without_copies(docs, _copies(edges, docs, scratch), scratch)
