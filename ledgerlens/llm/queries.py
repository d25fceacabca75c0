"""The queries opN_<name>: every operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embeddings, lm, lpt, mixing, packing, pii, quality, simhash, spotsigs, warc
from .common import read

#: Vocabulary file of op3, on every node; described by the package public_tokenizers.
VOCABULARY = "word_bpe_49k.json"
SHARDS = 16


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def op2_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(read(spark, sf_dir, "documents"))
    base = {k: F.col(k) for k in pii.KINDS}
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS),
        F.sha2(pii.span_text(base), 256).alias("base_sha256"),
        pii.span_text({**base, "term": F.col("terms")}).alias("spans"),
    )


def op3_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), vocabulary_path(), capacity=4096, closing_id=2)


def op4_lpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = lpt.shard_documents(read(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.warc_round_trip(read(spark, sf_dir, "pages"), min_revisit_bytes=0)
    full = lambda c: F.when(F.col("record_type") == "revisit", F.col(f"original.{c}")).otherwise(F.col(f"response.{c}")).alias(c)
    return captures.select("page_id", full("payload_bytes"), full("payload_digest"), "record_type", F.col("original.page_id").alias("refers_to"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(read(spark, sf_dir, "documents"), shingle=4, radius=4)
    return groups.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.kneser_ney_scores(read(spark, sf_dir, "documents"), folds=7, held=2)


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprint_edits(read(spark, sf_dir, "documents"))


def op9_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.vector_groups(read(spark, sf_dir, "embeddings"), threshold=0.93)


def op10_poisson(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.poisson_mix(read(spark, sf_dir, "documents"), seed=1, epochs=1.0, temper=0.5)
    return mixed.select("doc_id", "source", "n_copies", "copy_no", F.round("rate", 6).alias("rate"), "shuffle_key", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_bradley_terry, op2_disclosure, op3_bin_slack, op4_lpt, op5_warc, op6_simhash, op7_kneser_ney, op8_spotsigs, op9_itq, op10_poisson)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op5_warc": warc.oracle(), "op10_poisson": mixing.oracle(seed=1, epochs=1.0, temper=0.5)}
