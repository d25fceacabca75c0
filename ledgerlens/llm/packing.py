"""Packing token streams into fixed windows by minimum bin slack.

A document's ids (tokenizer ids, then the closing id) are cut into whole windows and one
remainder. Remainders are packed uncut: the multiset of remaining lengths is a histogram of
at most ``capacity`` entries, whatever the corpus. For each window the largest remaining
length is taken and a bitset subset-sum dynamic programme over the multiset finds the sum
closest to the capacity; backtracking gives how often each length is used. The same pattern
is applied as often as its lengths last, so the driver solves a few thousand windows at most.
A remainder finds its window by its rank among those of its length.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, with_rank

#: Words of the most distinct texts that a worker keeps ids for; beyond it, it starts anew.
CACHE_WORDS = 1_200_000
_SHIFT = 48


def _raw(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordCachedTokenizer:
    """Ids of texts as little-endian uint32 bytes, each distinct word tokenized once.

    Only for vocabularies with the normaliser and pre-tokenizer below, whose words _WORDS finds; a
    text with any character outside the plain set, or with a special token's string, goes
    through the tokenizer whole, and so do all texts with any other vocabulary.
    """

    # The parts of the vocabulary file that the expressions below stand for.
    NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
    PRE_TOKENIZER = {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    }

    _UNSAFE = re.compile("[^\t\n\r\x20-\x7eÀ-ÖØ-öø-įı-ňŊ-ž¡¿«»–—‘’“”…]")
    _WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[^\\s0-9a-zß-öø-ž]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        # a worker has one core's share: the library's threads cost more than they give
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.whole = Tokenizer.from_file(path)
        # for single words of plain texts, on which the normaliser and the split change nothing
        self.single = Tokenizer(self.whole.model)
        self.single.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)
        parts = json.loads(self.whole.to_str())
        self.known = parts["normalizer"] == self.NORMALIZER and parts["pre_tokenizer"] == self.PRE_TOKENIZER and parts["post_processor"] is None
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.ids: dict[str, bytes] = {}

    def _plain(self, text: str) -> bool:
        return self.known and not self._UNSAFE.search(text) and not any(s in text for s in self.special)

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.ids) > CACHE_WORDS:
            self.ids = {}
        plain = [self._plain(t) for t in texts]
        words = [self._WORDS.findall(t.lower()) if p else None for t, p in zip(texts, plain)]
        new = set()
        for w in words:
            if w:
                new.update(w)
        new = list(new.difference(self.ids))  # not "- keys()", which walks the whole cache for each call
        for w, e in zip(new, self.single.encode_batch_fast(new, add_special_tokens=False)):
            self.ids[w] = _raw(e.ids)
        get = self.ids.__getitem__
        return [b"".join(map(get, w)) if w is not None else _raw(self.whole.encode(t, add_special_tokens=False).ids) for t, w in zip(texts, words)]


_TOKENIZERS: dict[str, WordCachedTokenizer] = {}


def tokenizer(path: str) -> WordCachedTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordCachedTokenizer(path)
    return _TOKENIZERS[path]


def pieces(docs: DataFrame, vocabulary: str, capacity: int, closing_id: int, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): whole windows and the remainder.

    A null or empty text is the closing id alone; long texts are cut into as many windows as
    they fill; repeated rows and null ids are kept; an empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    close = np.array([closing_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids

    def work(batches):
        tok = tokenizer(vocabulary)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                src, start, length, crc, total, ids = [], [], [], [], [], []
                for i, raw in enumerate(tok.encode([t or "" for t in part.column(1).to_pylist()])):
                    raw += close
                    n = len(raw) // 4
                    for s in range(0, n, capacity):
                        cut = raw[4 * s : 4 * (s + capacity)]
                        src.append(i)
                        start.append(s)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                        total.append(n)
                        if keep_ids:
                            ids.append(np.frombuffer(cut, "<u4").astype(np.int32))
                cols = [part.column(0).take(pa.array(src, pa.int32())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                if keep_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(work, schema)


def fill_window(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, the largest left among them, whose sum is closest to capacity."""
    lengths = sorted((x for x, n in counts.items() if n), reverse=True)
    first = lengths[0]
    target = capacity - first
    mask = (1 << (target + 1)) - 1
    reach, steps = 1, []
    for x in lengths:
        if x > target:
            continue
        most, k = min(counts[x] - (x == first), target // x), 1
        while most > 0 and not reach >> target & 1:
            k = min(k, most)
            steps.append((x, k, reach))
            reach |= reach << (k * x) & mask
            most -= k
            k *= 2
        if reach >> target & 1:
            break
    at = reach.bit_length() - 1
    used = {first: 1}
    for x, k, before in reversed(steps):
        if not before >> at & 1:
            at -= k * x
            used[x] = used.get(x, 0) + k
    return used


def plan_windows(histogram: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Runs of ranks by length: each maps ranks from ``rank`` on to windows and offsets."""
    left = {x: n for x, n in histogram.items() if n}
    taken = dict.fromkeys(left, 0)
    base, runs = 0, []
    while left:
        used = fill_window(left, capacity)
        times = min(left[x] // k for x, k in used.items())
        at = 0
        for x, k in sorted(used.items(), reverse=True):
            runs.append((x, taken[x], base, k, at))
            taken[x] += times * k
            left[x] -= times * k
            if not left[x]:
                del left[x]
            at += x * k
        base += times
    runs.sort()
    cols = np.array(runs, np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "window", "each", "offset"), cols.T))


def place(ranked: DataFrame, plan: dict[str, np.ndarray]) -> DataFrame:
    """Adds sequence_id and offset to pieces with their rank among those of their length.

    Pieces of equal length are told apart by rank alone, so ties and repeats get places of
    their own; no pieces give no rows; all columns but the rank are handed on.
    """
    names = [c for c in ranked.columns if c != "rank"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")

    def work(batches):
        at = (plan["length"] << _SHIFT) + plan["rank"]
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            run = np.searchsorted(at, (length << _SHIFT) + rank, "right") - 1
            ahead, each = rank - plan["rank"][run], plan["each"][run]
            cols = [b.column(b.schema.get_field_index(c)) for c in names]
            cols += [pa.array(plan["window"][run] + ahead // each), pa.array(plan["offset"][run] + ahead % each * length)]
            yield pa.RecordBatch.from_arrays(cols, [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(work, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 4096, closing_id: int = 2, keep_ids: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    A null or empty text is the closing id alone; repeated rows are packed each; a null
    doc_id is kept; an empty table gives an empty result; other columns are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession, "packing")
    cut = scratch.save(pieces(docs, vocabulary, capacity, closing_id, keep_ids), "pieces")
    histogram = {r.length: r["count"] for r in cut.groupBy("length").count().collect()}
    ranked = with_rank(cut, ["length"], [F.col("doc_id"), F.col("start"), F.col("ids_crc32")], "rank")
    return place(ranked, plan_windows(histogram, capacity))
