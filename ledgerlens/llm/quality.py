"""Quality by Bradley-Terry ranking: scores learned from preference pairs of documents.

Every labelled good document is preferred to every labelled bad one. A document's strength
is linear in features of its text alone, and P(a beats b) = sigmoid(strength a - strength b),
so the logistic loss of pairs is one on feature differences. A document passes if its
strength reaches the training strengths' quantile at the share of bad labels; the score
is a logistic curve through PASS_SCORE at that strength.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that are learned from at most: those with the least hashes of their ids.
TRAIN_ROWS = 20_000
#: Preference pairs drawn from them, good and bad documents in turn.
TRAIN_PAIRS = 200_000
PASS_SCORE = 0.3

_WORD = re.compile(r"\S+")
_LETTER_RUN = re.compile(r"[^\W\d_]+")
_MARK = re.compile(r"[^\w\s]")
_DIGIT = re.compile(r"\d")
_ODD = re.compile(r"[#$%&*|<>{}\[\]=~^\\/@_+]")
_UPPER_WORD = re.compile(r"\b[^\W\d_a-zß-ÿ]{2,}\b")
_MARK_RUN = re.compile(r"[^\w\s]{2,}")
_ENDING = re.compile(r"[.!?](?=\s|$)")
FEATURES = 24


def text_features(text: str | None) -> list[float]:
    """FEATURES numbers of a whole text; all 0 for null or blank ones."""
    words = _WORD.findall(text) if text else []
    n = len(words)
    if not n:
        return [0.0] * FEATURES
    chars = len(text)
    low = [w.lower() for w in words]
    freq = Counter(low)
    lines = [x for x in text.split("\n") if x.strip()]
    line_freq = Counter(lines)
    shingles = Counter(map(hash, zip(low, low[1:], low[2:]))) if n > 3 else Counter()
    marks, odd, digits = len(_MARK.findall(text)), len(_ODD.findall(text)), len(_DIGIT.findall(text))
    letters = _LETTER_RUN.findall(text)
    lengths = np.fromiter(map(len, words), np.float64, n)
    p = np.fromiter(freq.values(), np.float64, len(freq)) / n
    share = lambda x: x / n
    return [
        math.log1p(n),
        math.log1p(chars),
        float(lengths.mean()),
        float(lengths.std()),
        marks / chars,
        odd / chars,
        math.log1p(1000 * odd / chars),
        digits / chars,
        share(len(_UPPER_WORD.findall(text))),
        share(len(_MARK_RUN.findall(text))),
        share(len(_ENDING.findall(text))),
        share(text.count("!")),
        share(text.count("|")),
        math.log1p(len(lines)),
        math.log1p(n / len(lines)),
        1 - len(line_freq) / len(lines),
        max(len(x) * (k - 1) for x, k in line_freq.items()) / chars,
        len(freq) / n,
        math.log1p(len(freq)) / math.log1p(n),
        max(freq.values()) / n,
        float(-(p * np.log(p)).sum()),
        1 - len(shingles) / (n - 2) if n > 3 else 0.0,
        sum(map(len, letters)) / chars,
        sum(1 for c in words if len(c) <= 4) / n,
    ]


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    cut: float
    slope: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return z @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        at = self.slope * (self.strength(x) - self.cut) + math.log(PASS_SCORE / (1 - PASS_SCORE))
        return 1 / (1 + np.exp(-np.clip(at, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = TRAIN_PAIRS, ridge: float = 1e-3, seed: int = 7) -> Ranker:
    """x: features of labelled rows; y: their labels. Without both labels every score is 0.5."""
    dims = x.shape[1] if x.ndim == 2 else FEATURES
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        r = Ranker(np.zeros(dims), np.ones(dims), np.zeros(dims), 0.0, 1.0)
        r.cut = -math.log((1 - PASS_SCORE) / PASS_SCORE)
        return r
    mean, scale = x.mean(0), x.std(0)
    scale[scale == 0] = 1
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    total = min(pairs, len(good) * len(bad))
    diff = z[rng.choice(good, total)] - z[rng.choice(bad, total)]
    w = np.zeros(dims)
    for _ in range(50):  # Newton steps on the mean loss of pairs
        p = 1 / (1 + np.exp(np.clip(diff @ w, -500, 500)))
        gradient = -(diff * p[:, None]).mean(0) + ridge * w
        curve = (diff * (p * (1 - p))[:, None]).T @ diff / total + ridge * np.eye(dims)
        move = np.linalg.solve(curve, gradient)
        w -= move * min(1, 5 / (np.linalg.norm(move) + 1e-12))
        if np.abs(move).max() < 1e-7:
            break
    out = Ranker(mean, scale, w, 0.0, 1.0)
    s = out.strength(x)
    out.cut = float(np.quantile(s, len(bad) / (len(good) + len(bad))))
    base = math.log(PASS_SCORE / (1 - PASS_SCORE))
    known = np.concatenate([good, bad])

    def loss(a: float) -> float:
        at = np.clip(a * (s[known] - out.cut) + base, -500, 500)
        return float(np.mean(np.logaddexp(0, np.where(y[known] == 1, -at, at))))

    out.slope = min((10 ** (k / 8) for k in range(-16, 13)), key=loss)
    return out


def _features_of(docs: DataFrame, names: list[str]) -> DataFrame:
    def work(batches):
        for b in batches:
            x = [text_features(t.as_py()) for t in b.column(b.schema.get_field_index("_text"))]
            cols = [b.column(b.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(x, pa.list_(pa.float64()))], [*names, "x"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*names, F.col("text").cast("string").alias("_text")).mapInArrow(work, f"{kinds}, x array<double>")


def fold(doc_id, folds: int = 5):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)), F.lit(0))


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, rows: int = TRAIN_ROWS) -> Ranker:
    """Learns from labelled rows outside the held-out fold, at most ``rows`` of them.

    Labels and texts that are null count as none and empty; where ids repeat, each text counts
    with each label of its id, ``rows`` of such pairs at most; without rows of both labels all
    scores are 0.5.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("_y"))
    known = known.filter(fold(F.col("doc_id"), folds) != held)
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "_y").limit(rows)
    met = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # of TRAIN_ROWS rows at most
    got = _features_of(met, ["doc_id", "_y"]).orderBy("doc_id", "_y").limit(rows).select("_y", "x").toPandas()
    return fit(np.array(got["x"].tolist(), np.float64).reshape(-1, FEATURES), got["_y"].to_numpy())


def score_documents(docs: DataFrame, ranker: Ranker, folds: int = 5, held: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    Null and empty texts have the features 0 and a score like any other; repeated rows score
    alike; a null doc_id counts as held out; an empty table gives an empty result; columns
    besides doc_id and text are never read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches):
        for b in batches:
            if b.num_rows:
                x = np.array([text_features(t.as_py()) for t in b.column(1)])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ranker.score(x))], ["doc_id", "score"])

    scored = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(work, f"doc_id {kind}, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", F.when(F.col("score") >= PASS_SCORE, 1).otherwise(0).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """docs without the rows that the ranker rejects; all columns, whatever their names, and their order stay.

    Null and empty texts have the features 0 and stay or go together; repeated rows too; rows
    without doc_id are judged by their texts; an empty table gives an empty result.
    """
    inner = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").cast("string").alias("_t"))
    schema = inner.select("_row").schema

    def work(batches):
        for b in batches:
            if b.num_rows:
                x = np.array([text_features(t.as_py()) for t in b.column(1)])
                yield pa.RecordBatch.from_arrays([b.column(0)], ["_row"]).filter(pa.array(ranker.score(x) >= PASS_SCORE))

    return inner.mapInArrow(work, schema).select("_row.*")
