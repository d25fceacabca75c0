"""Corpus pipeline: quality filter, near-duplicates, personal data, mixing and packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before has kept;
all but the last return the columns of documents, others that docs has included.

Nulls in any column are let through: a null or empty text is judged, compared, mixed and packed as
an empty one, a row without doc_id is no copy of another. Repeated rows are judged alike; of those
with one doc_id the near-copies stage keeps one. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import mixing, packing, pii, quality, simhash
from ledgerlens.llm.common import Scratch, read, temporary
from ledgerlens.llm.queries import vocabulary_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Bradley-Terry ranker passes; it learns from the labels of these documents."""
    return quality.keep_good(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of linked SimHash fingerprints: those of
    4-word shingles within 4 bits, and texts whose 5-word shingles have Jaccard 0.8."""
    return simhash.near_copy_dedup(docs, shingle=5, similarity=0.8, radius=4)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without protected entities and the terms that disclose them; n_chars follows."""
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target share asks for, in a global shuffle."""
    return mixing.poisson_mix(docs, seed=1, epochs=1.0, temper=0.5).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens with their places in windows of 4096."""
    return packing.pack_documents(docs, vocabulary_path(), capacity=4096, closing_id=2)


STAGES = [
    ("quality", keep_quality),
    ("simhash", drop_near_copies),
    ("pii", remove_personal_data),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL can't express the ranker's training, fingerprints' components or windows' programmes.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's result is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with temporary():
            done = scratch.save(stage(spark, docs, sf_dir), name)
        scratch.drop(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
