"""Interpolated modified Kneser-Ney n-gram scores from memory-mapped sorted hash arrays.

Counting. Tasks turn words into 56-bit hashes, count n-grams of the highest order in bounded
buffers (texts are preceded by order - 1 starts) and give on one packed block of counts for each
range of n-gram hashes; Spark shuffles blocks, not n-grams. The task of a range merges its
blocks, writes the hashes in order with their counts to the shared folder, and gives on what
the n-grams without their first and without their last word gather from it: how many
different ones end in them and how often, and, as contexts, their count and their numbers of followers
seen once, twice, more often. These are merged alike, an order at a time, down to words. An
n-gram's range depends on all its words, so very common words and pairs are spread over all
tasks. The number of ranges follows the length of the corpus, so a task's share does not grow.

Scoring. Workers map the files into memory, look up the sorted distinct hashes of a batch,
and compute P(w|h) = max(c(hw) - D, 0) / c(h) + gamma(h) P(w|h without its first word), where the lower
orders count the different words seen before, interpolated at last with 1 / (V + 1).

Words are told apart by 56 bits: among a billion different words about seven pairs are taken
for one; n-grams by 64 bits.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Tokens that a task buffers to count and to score, words whose hashes a worker keeps, and bytes of text to a range.
BUFFER = 1_000_000
SCORE_BUFFER = 500_000
CACHE_WORDS = 150_000
RANGE_BYTES = 12_000_000
START, END = 1, 2
_U = np.uint64
_WORD_BITS = 56


class WordHashes(dict):
    """56-bit hashes of words (bytes); START and END are no word's."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = max(3, xxhash.xxh64_intdigest(word) >> 8)
        return h


def tokens_of(text: bytes | None, hashes: WordHashes) -> list[int]:
    """Hashes of the words of a text in UTF-8, A-Z lower-cased, then END."""
    out = list(map(hashes.__getitem__, text.lower().split())) if text else []
    out.append(END)
    return out


def pair_hash(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    k = (u * _U(0x9E3779B97F4A7C15)) ^ (v * _U(0xC2B2AE3D27D4EB4F))
    k ^= k >> _U(31)
    k *= _U(0xBF58476D1CE4E5B9)
    return k ^ (k >> _U(29))


def gram_hash(words: np.ndarray) -> np.ndarray:
    """Of n-grams given as n rows; the range of a word is that of its top bits."""
    k = words[0] << _U(64 - _WORD_BITS)
    for w in words[1:]:
        k = pair_hash(k, w)
    return k


def windows(docs: list[list[int]], order: int) -> np.ndarray:
    """The order-gram that ends at each token, as ``order`` rows."""
    pad = order - 1
    sizes = np.array([len(d) for d in docs])
    n = int(sizes.sum())
    at = np.arange(n) + pad * np.repeat(np.arange(1, len(docs) + 1), sizes)
    all_words = np.full(n + pad * len(docs), START, _U)
    all_words[at] = np.fromiter((h for d in docs for h in d), _U, n)
    return np.stack([all_words[at - pad + i] for i in range(order)])


def _pack_words(words: np.ndarray) -> bytes:
    """n-grams as the different words among them and each place's number there."""
    known, at = np.unique(words, return_inverse=True)
    small = len(known) <= 1 << 16
    raw = known.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : _WORD_BITS // 8].tobytes()
    return np.array([words.shape[1], len(known)], "<u4").tobytes() + raw + at.reshape(words.shape).astype("<u2" if small else "<u4").tobytes()


def _unpack_words(raw: bytes, order: int) -> tuple[np.ndarray, int]:
    """n-grams as ``order`` rows, and where they end."""
    n, m = map(int, np.frombuffer(raw, "<u4", 2))
    width = _WORD_BITS // 8
    known = np.zeros((m, 8), np.uint8)
    known[:, :width] = np.frombuffer(raw, np.uint8, m * width, 8).reshape(m, width)
    kind = "<u2" if m <= 1 << 16 else "<u4"
    at = 8 + m * width
    numbers = np.frombuffer(raw, kind, n * order, at)
    return known.view("<u8").ravel()[numbers].reshape(order, n), at + numbers.nbytes


def _pack_counts(c: np.ndarray) -> bytes:
    """A byte each; 255 stands for a count that follows at the end."""
    small = np.where(c < 255, c, 255).astype(np.uint8)
    return small.tobytes() + c[c >= 255].astype("<u8").tobytes()


def _unpack_counts(raw: bytes, n: int, at: int = 0) -> tuple[np.ndarray, int]:
    """n counts packed from ``at`` on, and where they end."""
    out = np.frombuffer(raw, np.uint8, n, at).astype(np.int64)
    big = np.flatnonzero(out == 255)
    out[big] = np.frombuffer(raw, "<u8", len(big), at + n)
    return out, at + n + 8 * len(big)


def merged(keys: np.ndarray, *sums: np.ndarray):
    """Distinct keys in order, their first places, and each of sums added up by key."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
    return k[first], order[first], [np.add.reduceat(s[order], first) if len(k) else s[:0] for s in sums]


def _ranges(sorted_keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(range, from, to) of the ranges that sorted keys fall in."""
    at = (sorted_keys >> _U(64 - bits)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else []
    return [(int(at[a]), int(a), int(b)) for a, b in zip(cut, [*cut[1:], len(at)])]


def _blocks(keys: np.ndarray, words: np.ndarray, columns: np.ndarray, bits: int) -> tuple[list[int], list[bytes]]:
    """A packed block for each range of sorted keys."""
    cut = _ranges(keys, bits)
    return [p for p, _, _ in cut], [_pack_words(words[:, a:b]) + b"".join(_pack_counts(c[a:b]) for c in columns) for _, a, b in cut]


def _batch(parts: list[int], blocks: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blocks, pa.binary())], ["part", "block"])


def _count(batches, bits: int, order: int):
    """(part, block) of the counts of order-grams."""
    hashes = WordHashes()
    docs: list[list[int]] = []
    held = 0

    def flush():
        nonlocal held
        words = windows(docs, order)
        docs.clear()
        held = 0
        keys, first, (count,) = merged(gram_hash(words), np.ones(words.shape[1], np.int64))
        return _batch(*_blocks(keys, words[:, first], count[None], bits))

    for b in batches:
        for t in b.column(0).to_pylist():
            docs.append(tokens_of(t, hashes))
            held += len(docs[-1])
            if held >= BUFFER:
                yield flush()
                if len(hashes) > CACHE_WORDS:
                    hashes.clear()
    if docs:
        yield flush()


def _by_part(batches):
    """(part, blocks) of batches sorted by part."""
    part, blocks = None, []
    for b in batches:
        for p, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if p != part:
                if blocks:
                    yield part, blocks
                part, blocks = p, []
            blocks.append(raw)
    if blocks:
        yield part, blocks


def _write(path: str, *arrays: np.ndarray) -> None:
    """Whole or not at all, whoever else writes it: a task that is run again writes the same bytes anew."""
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(tmp, "wb") as f:
        for a in arrays:
            f.write(np.ascontiguousarray(a).tobytes())
    os.replace(tmp, path)


def _counts_of_counts(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in (1, 2, 3, 4)] + [int((c >= 3).sum()), len(c), int(c.sum())]


def _merge(batches, folder: str, bits: int, size: int, order: int, above: np.ndarray | None):
    """Writes the files of all ranges of ``size``-grams; yields statistics (part -1 - range) and, down to pairs, blocks.

    Columns are the count alone at the highest order, else total, n1, n2, n3 (as contexts of what
    is one longer, whose discounts are ``above``), the number of different words before, and the count.
    """
    top = size == order
    for part, raws in _by_part(batches):
        ws, cs = [], []
        for raw in raws:
            w, at = _unpack_words(raw, size)
            table = np.empty((1 if top else 6, w.shape[1]), np.int64)
            for row in table:
                row[:], at = _unpack_counts(raw, w.shape[1], at)
            ws.append(w)
            cs.append(table)
        raws.clear()
        words, columns = np.concatenate(ws, axis=1), np.concatenate(cs, axis=1)
        del ws, cs
        keys, first, columns = merged(gram_hash(words), *columns)
        words = words[:, first]
        path = f"{folder}/{size}-{part}"
        if top:
            c = count = columns[0]
            big = np.flatnonzero(c >= 255)
            _write(path, np.array([len(c), len(big)], "<u8"), keys, big.astype("<u8"), c[big].astype("<u8"), np.minimum(c, 255).astype(np.uint8))
        else:
            total, n1, n2, n3, c, count = columns
            rest = np.where(total > 0, (above[1] * n1 + above[2] * n2 + above[3] * n3) / np.maximum(total, 1), 1.0)
            _write(path, np.array([len(c), 0], "<u8"), keys, *(x.astype("<f8") for x in (total, rest, c, count)[: 4 if size == 1 else 3]))
        seen = c > 0
        stats = [*_counts_of_counts(c[seen]), int((count > 0).sum()), int(count.sum())]
        parts, blocks = [-1 - part], [np.array(stats, "<i8").tobytes()]
        if size > 1:
            words, c, count = words[:, seen], c[seen], count[seen]
            one, none = np.ones(len(c), np.int64), np.zeros(len(c), np.int64)
            both = np.concatenate([words[:-1], words[1:]], axis=1)
            as_context = [c, (c == 1) * one, (c == 2) * one, (c >= 3) * one, none, none]
            as_end = [none, none, none, none, one, count]
            low, at, table = merged(gram_hash(both), *(np.concatenate(x) for x in zip(as_context, as_end)))
            more = _blocks(low, both[:, at], np.array(table).reshape(6, len(low)), bits)
            parts, blocks = [*parts, *more[0]], [*blocks, *more[1]]
        yield _batch(parts, blocks)


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """D for counts 0, 1, 2, 3 and more; 0 <= D <= count."""
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
    of = lambda k, a, b: min(max(k - (k + 1) * y * b / a, 0.0), float(k)) if a else 0.5
    return np.array([0.0, of(1, n1, n2), of(2, n2, n3), of(3, n3, n4)])


@dataclass
class Model:
    folder: str
    bits: int
    order: int
    discounts: dict[int, np.ndarray] = field(default_factory=dict)  # by size of n-gram
    ranges: dict[int, set[int]] = field(default_factory=dict)  # those that have a file
    predecessors: int = 0  # different pairs
    word_rest: float = 1.0  # mass left to the uniform distribution
    vocabulary: int = 0
    tokens: int = 0

    def _cuts(self, size: int, keys: np.ndarray):
        have = self.ranges.get(size, set())
        return ((f"{self.folder}/{size}-{p}", a, b) for p, a, b in _ranges(keys, self.bits) if p in have)

    def table(self, size: int, keys: np.ndarray) -> np.ndarray:
        """Count as a context, mass left there, predecessors and, of words, count of sorted distinct n-grams below the highest order."""
        out = np.zeros((4, len(keys)))
        out[1] = 1.0
        for path, a, b in self._cuts(size, keys):
            have, vals = _mapped_table(path)
            at, hit = _found(have, keys[a:b])
            out[: len(vals), a:b][:, hit] = vals[:, at]
        return out

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted distinct n-grams of the highest order."""
        out = np.zeros(len(keys), np.int64)
        for path, a, b in self._cuts(self.order, keys):
            have, big, big_count, small = _mapped_counts(path)
            at, hit = _found(have, keys[a:b])
            c = small[at].astype(np.int64)
            many = np.flatnonzero(c == 255)
            c[many] = big_count[np.searchsorted(big, at[many].astype(_U))]
            out[a:b][hit] = c
        return out

    def score(self, docs: list[list[int]]) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base_score, score of each document's token hashes."""
        sizes = np.array([len(d) for d in docs])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        words = windows(docs, self.order)
        n = words.shape[1]
        keys, at = np.unique(np.concatenate([gram_hash(words[-1:]), gram_hash(words[-2:-1])]), return_inverse=True)
        total, rest, before, count = self.table(1, keys)[:, at]
        count = count[:n]
        below = lambda c, size: np.maximum(c - self.discounts[size][np.minimum(c, 3).astype(np.int64)], 0)
        p = below(before[:n], 1) / max(1, self.predecessors) + self.word_rest / (self.vocabulary + 1)
        for size in range(2, self.order + 1):
            total, rest = total[n:], rest[n:]  # of the contexts
            own = gram_hash(words[-size:])
            if size == self.order:
                keys, at = np.unique(own, return_inverse=True)
                c = self.counts(keys)[at]
                p = below(c, size) / np.maximum(total, 1) + rest * p
            else:
                keys, at = np.unique(np.concatenate([own, gram_hash(words[-size - 1 : -1])]), return_inverse=True)
                above, left, before, _ = self.table(size, keys)[:, at]
                p = below(before[:n], size) / np.maximum(total, 1) + rest * p
                total, rest = above, left
        base = np.log10((count + 1) / (self.tokens + self.vocabulary + 1))
        add = lambda x: np.add.reduceat(x, starts)  # noqa: E731  no document is empty: each has its end
        return sizes, add((count > 0).astype(np.int64)), add(base), add(np.log10(p))


_MAPS: dict[str, np.ndarray] = {}


def _mapped(path: str) -> np.ndarray:
    """A model file, mapped into memory once for each worker; one that is not there is an error."""
    if path not in _MAPS:
        if len(_MAPS) > 4096:
            _MAPS.clear()
        _MAPS[path] = np.memmap(path, np.uint8, "r")
    return _MAPS[path]


def _mapped_table(path: str):
    raw = _mapped(path)
    n = int(raw[:8].view("<u8")[0])
    return raw[16 : 16 + 8 * n].view("<u8"), raw[16 + 8 * n :].view("<f8").reshape(-1, n) if n else np.zeros((0, 0))


def _mapped_counts(path: str):
    raw = _mapped(path)
    n, m = map(int, raw[:16].view("<u8"))
    ends = np.cumsum([16, 8 * n, 8 * m, 8 * m])
    return *(raw[a:b].view("<u8") for a, b in zip(ends, ends[1:])), raw[ends[-1] :]


def _found(have: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``have`` of those of the sorted keys that are there, and which these are."""
    if not len(have):
        return np.empty(0, np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
    hit = have[at] == keys
    return at[hit], hit


def local_folder(path: str) -> str:
    """The shared folder as workers map it: it must be mounted under one path on all of them."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if path.startswith("/"):
        return path
    raise ValueError(f"memory-mapping needs a shared folder that is mounted on all workers; spark.checkpoint.dir is {path}")


def train(docs: DataFrame, scratch: Scratch, order: int = 2, range_bytes: int = RANGE_BYTES) -> Model:
    """Counts the texts of docs; a null text is empty (its end alone). ``order`` is 2 or more."""
    if order < 2:
        raise ValueError(f"an order of {order} has no contexts")
    text = F.col("text").cast("string").cast("binary")
    length = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    bits = max(4, (int(length) // range_bytes).bit_length())
    folder = local_folder(scratch.path("model"))
    os.makedirs(folder, exist_ok=True)
    model = Model(folder, bits, order)
    at = docs.select(text).mapInArrow(lambda bs: _count(bs, bits, order), "part int, block binary")
    above, before = None, None
    for size in range(order, 0, -1):
        dealt = at.repartitionById(1 << bits, "part").sortWithinPartitions("part")  # a range to each task
        merge = lambda bs, size=size, above=above: _merge(bs, folder, bits, size, order, above)
        done = scratch.save(dealt.mapInArrow(merge, "part int, block binary"), f"order{size}")
        rows = done.filter("part < 0").collect()  # a row for each range
        model.ranges[size] = {-1 - r.part for r in rows}
        stats = np.sum([np.frombuffer(r.block, "<i8") for r in rows], axis=0) if rows else np.zeros(9, np.int64)
        above = model.discounts[size] = discounts(*stats[:4].tolist())
        at = done.filter("part >= 0")
        if before is not None:
            scratch.drop(before)
        before = done
    scratch.drop(before)
    model.predecessors, model.vocabulary, model.tokens = int(stats[6]), int(stats[7]), int(stats[8])
    if model.predecessors:
        model.word_rest = float(above[1] * stats[0] + above[2] * stats[1] + above[3] * stats[4]) / model.predecessors
    return model


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Null and empty texts are their end alone; repeated rows score alike; an empty table
    gives an empty result; columns besides doc_id and text are never read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def work(batches):
        hashes = WordHashes()
        ids, held, size = [], [], 0

        def flush():
            cols = model.score(held)
            n = len(held)
            out = [pa.concat_arrays(ids), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(np.full(n, model.tokens)), pa.array(cols[2]), pa.array(cols[3])]
            ids.clear()
            held.clear()
            return pa.RecordBatch.from_arrays(out, names)

        for b in batches:
            done = 0
            for i, t in enumerate(b.column(1).to_pylist()):
                held.append(tokens_of(t, hashes))
                size += len(held[-1])
                if size >= SCORE_BUFFER:
                    ids.append(b.column(0).slice(done, i + 1 - done))
                    done, size = i + 1, 0
                    yield flush()
                    if len(hashes) > CACHE_WORDS:
                        hashes.clear()
            if done < b.num_rows:
                ids.append(b.column(0).slice(done))
        if held:
            yield flush()

    return docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(work, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def kneser_ney_scores(docs: DataFrame, folds: int = 7, held: int = 2, order: int = 2, scratch: Scratch | None = None) -> DataFrame:
    """Scores every row by a model of the rows outside the held-out fold; a null doc_id trains."""
    scratch = scratch or Scratch(docs.sparkSession, "lm")
    fold = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)), F.lit(-1))
    model = train(docs.filter(fold != held), scratch, order)
    scored = score_documents(docs, model)
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return scored.select("doc_id", (fold == held).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", perplexity.alias("perplexity"))
