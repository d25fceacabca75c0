"""Mixing sources to target weights by Poisson replication.

A source's rate is the mean number of times its documents must be repeated so that it holds
its target share of the volume (characters plus one a document). Each document draws a
uniform number from a seeded MD5 of its id and inverts the Poisson distribution with that
mean: the count depends on the id, the seed and the rate alone. Rows are exploded by their
counts and dealt anew by a hash of seed, id and copy, which shuffles the corpus globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

OWN = ("n_copies", "copy_no", "rate", "shuffle_key")


def source_rates(docs: DataFrame, by: str = "source", epochs: float = 1.0, temper: float = 0.5, weights: DataFrame | None = None) -> DataFrame:
    """(by, rate): mean repetitions of a source's documents.

    Target shares are ``weights`` (columns by, weight; other sources get none) or, without
    them, the shares of volume to the power ``temper``. The mixture has ``epochs`` times the volume.
    """
    volume = docs.groupBy(F.col(by).alias("_by")).agg(F.sum(F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)) + 1).alias("_v"))
    if weights is None:
        aimed = volume.withColumn("_w", F.pow(F.col("_v").cast("double"), F.lit(float(temper))))
    else:
        w = weights.groupBy(F.col(by).alias("_wby")).agg(F.sum("weight").cast("double").alias("_w"))
        aimed = volume.join(w, F.col("_by").eqNullSafe(F.col("_wby")), "left").select("_by", "_v", F.coalesce("_w", F.lit(0.0)).alias("_w"))
    total = aimed.agg(F.sum("_v").alias("_tv"), F.sum("_w").alias("_tw"))  # one row
    rate = F.when(F.col("_tw") > 0, F.lit(float(epochs)) * F.col("_tv") * F.col("_w") / F.col("_tw") / F.col("_v")).otherwise(0.0)
    return aimed.join(F.broadcast(total)).select("_by", rate.alias("rate"))


def poisson_cdf(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... so far that the rest is below any uniform number's step."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct((-rate).alias("logp"), F.array(F.exp(-rate)).alias("cdf"))

    def step(acc, j):
        logp = acc["logp"] + F.log(rate / j)
        return F.struct(logp.alias("logp"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + F.exp(logp))).alias("cdf"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["cdf"])).otherwise(F.array(F.lit(1.0)))


def uniform(seed: int, key: Column) -> Column:
    """In (0, 1), in steps of 2^-52, from MD5."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + 0.5) / F.lit(float(1 << 52))


def poisson_mix(docs: DataFrame, seed: int = 1, by: str = "source", epochs: float = 1.0, temper: float = 0.5, weights: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """docs' columns, each row n_copies times, with copy_no from 1, rate and shuffle_key.

    Documents that draw 0 go: that is what the rates ask for. Null sources are a source of
    their own, null texts have no characters, repeated rows draw alike, a null doc_id draws
    like an empty one; an empty table gives an empty result. Columns of docs with the names
    of added ones (OWN) are replaced, all others are handed on, whatever their names.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mixing")
    rates = scratch.save(source_rates(docs, by, epochs, temper, weights).select("_by", "rate", poisson_cdf(F.col("rate")).alias("_cdf")), "rates")
    names = [c for c in docs.columns if c not in OWN]
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), F.col(by).alias("_of"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_key"))
    # no hint: the planner knows the size of the written table and sends it out only below its limit
    met = row.join(rates, F.col("_of").eqNullSafe(F.col("_by"))).withColumn("_u", uniform(seed, F.col("_key")))
    drawn = met.withColumn("n_copies", F.size(F.filter("_cdf", lambda c: c < F.col("_u"))).cast("int")).filter("n_copies > 0")
    copies = drawn.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    tag = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("_key"), F.lit("|"), F.col("copy_no").cast("string")).cast("binary")), 1, 16)
    out = copies.select(*(F.col(f"_row.`{c}`").alias(c) for c in names), "n_copies", "copy_no", "rate", tag.alias("shuffle_key"))
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def oracle(seed: int = 1, epochs: float = 1.0, temper: float = 0.5) -> str:
    return f"""
with volume as (select source, cast(sum(coalesce(length(text), 0) + 1) as double) as v from documents group by source),
rates as (select source, {epochs} * (select sum(v) from volume) * pow(v, {temper}) / (select sum(pow(v, {temper})) from volume) / v as rate from volume),
cdf as (
  select source, rate, j, sum(exp(-rate + j * ln(rate) - lgamma(j + 1))) over (partition by source order by j) as c
  from (select source, rate, unnest(generate_series(0, cast(ceil(rate + 12 * sqrt(rate) + 30) as bigint))) as j from rates)),
drawn as (select *, (cast('0x' || substr(md5('{seed}|' || coalesce(cast(doc_id as varchar), '')), 1, 13) as bigint) + 0.5) / 4503599627370496.0 as u from documents),
counted as (
  select d.doc_id, d.text, d.lang, d.source, d.n_chars, max(cdf.rate) as rate, cast(count(*) filter (where cdf.c < d.u) as integer) as n_copies
  from drawn d join cdf on d.source is not distinct from cdf.source
  group by d.doc_id, d.text, d.lang, d.source, d.n_chars)
select doc_id, source, n_copies, cast(copy_no as integer) as copy_no, round(rate, 6) as rate,
  substr(md5('{seed}|' || coalesce(cast(doc_id as varchar), '') || '|' || cast(copy_no as varchar)), 1, 16) as shuffle_key, text
from (select *, unnest(generate_series(1, n_copies)) as copy_no from counted where n_copies > 0)
"""
