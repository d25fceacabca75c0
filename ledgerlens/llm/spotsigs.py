"""SpotSigs fingerprints with DataFrame functions alone.

A spot signature is an anchor (a very common word) with the next ``CHAIN`` content words after it,
anchors between them skipped. All anchors of a run share their chain, so a run gives a signature
for each different anchor in it, at most the list's length, and the signatures of a text take
space in proportion to it. A text's fingerprint is the set of its signatures' 32-bit hashes; a
text without any has the hash of its words as its only one, so that equal texts always have
equal fingerprints. Two fingerprints are compared by Jaccard; in ``spotsigs_pairs`` a pair whose set
lengths alone rule the threshold out is never looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

# Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was were with "
    "das den der die ein eine ist mit nicht sich und von zu "
    "avec dans de des du en est et la le les par pour que qui sur un une "
    "con del el es las los para por se su una y"
).split()
CHAIN = 2


def _let(value: Column, body) -> Column:
    """body(value) with value computed once; what a lambda refers to is else computed for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def signatures(text: Column) -> Column:
    """Sorted distinct signature hashes (array<int>) of a text that is not null.

    Words are runs of letters and digits, lower-cased. With content words marked by one
    character, splitting gives the run of anchors before each of them.
    """
    anchor = lambda w: w.isin(*ANCHORS)
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def parts(w):
        marked = F.array_join(F.transform(w, lambda x: F.when(anchor(x), F.concat(x, F.lit(" "))).otherwise(F.lit("|"))), "")
        return F.struct(w.alias("words"), F.filter(w, lambda x: ~anchor(x)).alias("content"), F.split(marked, r"\|").alias("runs"))

    def hashes(p):
        def of(run, k):
            chain = [F.element_at(p["content"], k + 1 + i) for i in range(CHAIN)]
            return F.transform(F.array_distinct(F.split(F.rtrim(run), " ")), lambda a: F.hash(a, *chain))

        starts = F.slice(p["runs"], F.lit(1), F.greatest(F.size(p["content"]) - (CHAIN - 1), F.lit(0)))
        each = F.transform(starts, lambda run, k: F.when(run != "", of(run, k)).otherwise(F.array().cast("array<int>")))
        whole = F.array(F.hash(F.array_join(p["words"], " ")))
        return _let(F.sort_array(F.array_distinct(F.flatten(each))), lambda found: F.when(F.size(found) > 0, found).otherwise(whole))

    return _let(words, lambda w: _let(parts(w), hashes))


def as_text(sigs: Column) -> Column:
    """Eight lowercase hex digits for each signature."""
    return F.lower(F.array_join(F.transform(sigs, lambda x: F.substring(F.lpad(F.hex(x.cast("long")), 16, "0"), 9, 8)), ""))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two sets of signatures."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def with_next(docs: DataFrame, columns: list[str], key: str = "doc_id", buckets: int | None = None) -> DataFrame:
    """docs(key, columns) with _k, _b, _guest: dealt to ranges of the key, so that a window over
    (_b) ordered by (_guest, _k, columns) sees each row's successor.

    Ranges come from approximate quantiles of the key, as many as a multiple of the session's
    shuffle partitions. The first row of a range is also a guest at the end of the range
    before it, and the very first one at the end of the last.
    """
    spark = docs.sparkSession
    buckets = buckets or 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.withColumn("_k", F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)).cast("long")))
    cuts = sorted(set(keyed.agg(F.percentile_approx("_k", [i / buckets for i in range(1, buckets)], 100 * buckets).alias("q")).first().q or []))
    depth = len(cuts).bit_length()
    bounds = F.array(*[F.lit(x).cast("long") for x in cuts]) if cuts else F.array().cast("array<long>")
    # binary search for the number of bounds that are not above the key
    halved = F.array(*[F.lit(1 << i) for i in reversed(range(depth))]) if depth else F.array().cast("array<int>")
    fits = lambda at, step: (at + step <= len(cuts)) & (F.get(bounds, at + step - 1) <= F.col("_k"))
    placed = keyed.withColumn("_b", F.aggregate(halved, F.lit(0), lambda at, step: F.when(fits(at, step), at + step).otherwise(at)))
    firsts = [(r._b, r.k) for r in placed.groupBy("_b").agg(F.min("_k").alias("k")).orderBy("_b").collect()]  # a row for each range
    before = [(k, firsts[i - 1][0]) for i, (_, k) in enumerate(firsts)]
    guests = spark.createDataFrame(before, "_gk long, _gb int")
    met = placed.join(F.broadcast(guests), F.col("_k") == F.col("_gk"), "left")
    own = F.struct(F.col("_b").alias("b"), F.lit(0).alias("g"))
    spots = F.when(F.col("_gb").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("_gb").alias("b"), F.lit(1).alias("g"))))
    out = met.withColumn("_at", F.explode(spots))
    return out.select(key, *columns, "_k", F.col("_at.b").alias("_b"), F.col("_at.g").alias("_guest"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """For every row: its fingerprint, that of its edited text, and the likeness of both and of the next row's.

    The edited text has the last quarter of its code points (rounded down) replaced by the
    first as many of the next document in the order of doc_id, after the last the first.
    Null texts are empty; null ids come first; rows that repeat an id follow each other in
    the order of their texts; a single row is its own successor; an empty table gives an
    empty result; other columns are ignored.
    """
    base = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    w = Window.partitionBy("_b").orderBy("_guest", "_k", "text")
    at = with_next(base, ["text"]).withColumn("_next", F.lead("text").over(w))
    n, cut = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    at = at.withColumn("n_chars", n.cast("long")).withColumn("sigs", signatures(F.col("text")))
    at = at.withColumn("next_sigs", F.lead("sigs").over(w)).filter("_guest = 0")
    at = at.withColumn("edited", F.concat(F.col("text").substr(F.lit(1), n - cut), F.col("_next").substr(F.lit(1), cut)))
    at = at.select("doc_id", "n_chars", "sigs", "next_sigs", F.sha2("edited", 256).alias("edited_sha256"), signatures(F.col("edited")).alias("edited_sigs"))
    return at.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("sigs")).alias("fingerprint"),
        as_text(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def spotsigs_pairs(docs: DataFrame, threshold: float = 0.8, scratch: Scratch | None = None, block: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(pairs, classes): pairs(a, b, likeness) of class ids with Jaccard >= threshold, and classes(doc_id, class_id).

    Equal fingerprints are one class (its least doc_id), so copies are never paired out; there
    are as many pairs as there are links between different fingerprints.
    Sets are partitioned by length: ranges whose ends differ by the factor threshold, so a
    set can only match in its own or the next range. Within a range a set posts its rarest
    signatures, as many as any partner must share one of. A pair is looked at once, where its
    first common signature is posted, and only if the lengths and what is left of both sets from there
    on allow the threshold; survivors are verified by their whole sets. Postings of a signature
    in a range are dealt into blocks of about ``block`` rows, whose pairs are compared in tasks of their own.

    Null texts are empty, and empty texts are alike; repeated rows each get a row of classes;
    rows without doc_id get a class only through an equal text that has one, else null, and are in no
    pair; an empty table gives empty results; other columns are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession, "spotsigs")
    sets = scratch.save(docs.select("doc_id", signatures(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("sigs")), "sets")
    classes = scratch.save(sets.groupBy("sigs").agg(F.min("doc_id").alias("class_id")).withColumn("n", F.size("sigs")), "classes")
    posted = classes.filter("class_id is not null").select("class_id", "n", F.explode("sigs").alias("sig"))
    rarity = posted.groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    prefix = (F.col("n") - F.ceil(F.col("n") * F.lit(threshold)) + 1).cast("int")
    ordered = posted.join(rarity, "sig").withColumn("r", F.row_number().over(Window.partitionBy("class_id").orderBy("df", "sig"))).filter(F.col("r") <= prefix)
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(1 / threshold)) + 1e-9).cast("int")
    ordered = ordered.groupBy("class_id", "n").agg(F.collect_list(F.struct("r", "sig", "df")).alias("p"))  # a set's own signatures
    ordered = ordered.select("class_id", "n", band.alias("band"), F.sort_array("p").alias("p")).select("*", F.transform("p", lambda x: x["sig"]).alias("first"), F.explode("p").alias("x"))
    ordered = scratch.save(ordered.filter("x.df > 1").select("class_id", "n", "band", "first", F.col("x.sig").alias("sig"), F.col("x.r").alias("r")), "postings")
    wide = F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band")
    sizes = ordered.select("sig", wide).groupBy("sig", "band").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("g"))
    sizes = scratch.save(sizes.filter("g > 1").select(F.col("sig").alias("_sig"), F.col("band").alias("_band"), "g"), "hot")

    def dealt(rows: DataFrame, name: str, other: str) -> DataFrame:
        met = rows.join(sizes, (rows.sig == sizes._sig) & (rows.band == sizes._band), "left").withColumn("g", F.coalesce("g", F.lit(1)))
        own = F.pmod(F.xxhash64("class_id"), F.col("g")).cast("int")
        return met.withColumn(other, F.explode(F.sequence(F.lit(0), F.col("g") - 1))).withColumn(name, own).select("class_id", "n", "first", "sig", "band", "r", "ua", "ub")

    left = dealt(ordered, "ua", "ub").select(F.col("class_id").alias("a"), F.col("n").alias("na"), F.col("first").alias("fa"), F.col("r").alias("ra"), "sig", "band", "ua", "ub")
    right = dealt(ordered.select("class_id", "n", "first", "sig", "r", wide), "ub", "ua").select(F.col("class_id").alias("b"), F.col("n").alias("nb"), F.col("first").alias("fb"), F.col("r").alias("rb"), "sig", "band", "ua", "ub")
    shorter = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    least = F.ceil((F.col("na") + F.col("nb")) * F.lit(threshold / (1 + threshold)) - 1e-9)
    left_over = F.least(F.col("na") - F.col("ra"), F.col("nb") - F.col("rb")) + 1 >= least
    here = F.element_at(F.array_intersect("fa", "fb"), 1) == F.col("sig")
    near = left.join(right, ["sig", "band", "ua", "ub"]).filter(shorter & (F.col("na") >= F.col("nb") * threshold) & left_over & here).select("a", "b")
    sa = classes.select(F.col("class_id").alias("a"), F.col("sigs").alias("sa"))
    sb = classes.select(F.col("class_id").alias("b"), F.col("sigs").alias("sb"))
    pairs = near.join(sa, "a").join(sb, "b").select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness")).filter(F.col("likeness") >= threshold)
    member = sets.join(classes, "sigs").select("doc_id", "class_id")
    return pairs, member
