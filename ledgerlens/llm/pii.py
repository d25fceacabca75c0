"""Personal data by patterns and by information-theoretic disclosure, DataFrame functions alone.

Patterns find the protected entities (email, ip, card, phone). The other words of the texts that
mention an entity are weighed by what they reveal of it: with p estimated from the corpus,
PMI(entity; term) = log p(e, t) / (p(e) p(t)) against the entity's information IC(e) =
-log p(e). A term whose PMI reaches ``generalise`` x IC(e) is replaced by its category in the
entity's texts, from ``remove`` x IC(e) on it is taken out. Every entity is weighed with every
word of its texts. Where they meet in fewer than ``support`` different texts the term's
frequency is smoothed, as if one further text held it: chance alone then is no disclosure (in a
corpus of few texts none comes out), and what few texts show is generalised before it is
removed. Terms that ``support`` texts or more bear out, and that stand by the entity in at least the
share ``elsewhere`` of their texts, go in all texts, with or without the entity: where they stand
alone they still name it more often than not.

All three probabilities count different texts; copies of a text thus can neither make a term
look revealing nor hide that it is.

Only texts with entities are kept and paired. A term of more texts than any entity could have in
common with it is dropped before pairing, which loses nothing: j <= de, so PMI / IC >= generalise
needs dt <= (n + 1) (de / n) ^ generalise. Entities of the same texts are one class, so that the
addresses of a list are paired once. Where few words or texts must be found among all, a bitmap
of their hashes (at most 2 ** BITMAP_BITS bits, whatever the corpus) lets few others through, and an
equi-join settles these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

# The base patterns. Quantifiers that nothing after them could take back from
# are possessive, and a match may only start where a run of its first class does (or where
# the match before has ended), which finds the same matches in time linear in the text.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
_IP_OK = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(?:\.|$)){4}$"
_WORD = r"\p{L}+"
#: Matches whose lengths are summed at once.
BLOCK = 64
#: Bits of a bitmap at most: a megabyte for each task.
BITMAP_BITS = 23


def let(value: Column, body) -> Column:
    """body(value) with value computed once; what a lambda refers to is else computed for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc, i):
        d = digits.substr(n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return x.rlike(_IP_OK)
    n = F.length(_digits(x))
    if kind == "phone":
        return n.between(9, 15)
    return F.when(n.between(13, 19), luhn(_digits(x))).otherwise(F.lit(False))


def _entity(kind: str, x: Column) -> Column:
    value = F.lower(x) if kind in ("email", "ip") else _digits(x)
    return F.concat(F.lit(f"{kind} "), value)


def _entities(kind: str) -> Column:
    return F.transform(kind, lambda s: _entity(kind, s["value"]))


def _labelled(kind: str) -> Column:
    return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"<{kind.upper()}>").alias("label")))


def _located(text: Column, pattern: str, ok) -> Column:
    """array<struct<start,end,value>> of the matches that are ok; code points, end exclusive.

    A match starts after all gaps and matches before it: the sums of whole blocks of these, and
    what its own block has before it.
    """
    add = lambda xs: F.aggregate(xs, F.lit(0), lambda acc, x: acc + x)

    def spots(p):
        def place(s):
            block = F.floor(s["i"] / BLOCK).cast("int")
            start = add(F.slice(p["sums"], F.lit(1), block)) + add(F.slice(p["sizes"], block * BLOCK + 1, s["i"] - block * BLOCK)) + F.length(F.element_at(p["gaps"], s["i"] + 1))
            return F.struct(start.cast("long").alias("start"), (start + F.length(s["value"])).cast("long").alias("end"), s["value"].alias("value"))

        return F.transform(p["good"], place)

    def summed(p):
        ends = F.sequence(F.lit(0), F.size(p["sizes"]), F.lit(BLOCK))
        sums = F.transform(ends, lambda at: add(F.slice(p["sizes"], at + 1, F.lit(BLOCK))))
        return let(F.struct(p["good"].alias("good"), p["gaps"].alias("gaps"), p["sizes"].alias("sizes"), sums.alias("sums")), spots)

    def sized(p):
        good = F.filter(F.transform(p["found"], lambda x, i: F.struct(i.alias("i"), x.alias("value"))), lambda s: ok(s["value"]))
        sizes = F.zip_with(p["found"], F.slice(p["gaps"], F.lit(1), F.size(p["found"])), lambda f, g: F.length(f) + F.length(g))
        none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
        return let(F.struct(good.alias("good"), p["gaps"].alias("gaps"), sizes.alias("sizes")), lambda q: F.when(F.size(q["good"]) > 0, summed(q)).otherwise(none))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(F.struct(found.alias("found"), F.split(text, pattern, -1).alias("gaps")), sized)


def base_spans(text: Column) -> dict[str, Column]:
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    out = {}
    for kind, pattern in PATTERNS.items():
        if kind == "email":
            may = F.contains(text, F.lit("@"))
        elif kind == "phone":
            may = F.contains(text, F.lit("+"))
        else:
            may = text.rlike("[0-9]")
        out[kind] = F.when(may, _located(text, pattern, lambda x, k=kind: _valid(k, x))).otherwise(none)
    return out


def _replaced(text: Column, spans: Column, by) -> Column:
    """text with by(span) in place of each of the spans, which are in order; of overlapping ones the first counts."""

    def step(acc, s):
        gap = text.substr((acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        fresh = F.struct(F.concat(acc["out"], gap, by(s, s["start"])).alias("out"), s["end"].alias("at"))
        over = F.struct(F.concat(acc["out"], by(s, acc["at"])).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))
        return F.when(s["start"] >= acc["at"], fresh).otherwise(over)

    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], text.substr((acc["at"] + 1).cast("int"), F.length(text))))


def _blank(s, at: Column) -> Column:
    """As many blanks as the span reaches beyond ``at``."""
    return F.repeat(F.lit(" "), F.greatest(s["end"] - at, F.lit(0)).cast("int"))


def _words(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), F.lower))


def _text_key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), _text_key(text).alias("text_key"))


def bitmap(values: DataFrame, column: str, n: int):
    """Tests a column for membership among the n ``values``: always true of those, seldom of others."""
    bits = min(BITMAP_BITS, max(10, (16 * n).bit_length()))
    at = F.pmod(F.xxhash64(column), F.lit(1 << bits))
    words = values.select(F.shiftright(at, 6).alias("w"), F.pmod(at, F.lit(64)).cast("int").alias("k")).distinct()
    words = words.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("b"))
    every = values.sparkSession.range((1 << bits) // 64).join(words, F.col("id") == F.col("w"), "left").select("id", F.coalesce("b", F.lit(0).cast("long")).alias("b"))
    held = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "b"))), lambda s: s["b"]).alias("bits")).scalar()  # 2 ** bits bits

    def test(x: Column) -> Column:
        h = F.pmod(F.xxhash64(x), F.lit(1 << bits))
        return F.getbit(F.element_at(held, (F.shiftright(h, 6) + 1).cast("int")), F.pmod(h, F.lit(64)).cast("int")) == 1

    return test


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, email, ip, card, phone, held): base spans, and the text where it has any."""
    at = _texts(docs).select("doc_id", "text_key", "text", *(c.alias(k) for k, c in base_spans(F.col("text")).items()))
    some = F.size("email") + F.size("ip") + F.size("card") + F.size("phone") > 0
    return at.select("doc_id", "text_key", *KINDS, F.when(some, F.col("text")).alias("held"))


def document_counts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(term, dt): the number of different texts that hold each word. keys(text_key, n): rows of each text.

    Only texts that may have copies are moved to be counted once.
    """
    copied = keys.filter("n > 1").select("text_key")
    may = bitmap(copied, "text_key", copied.count())
    texts = _texts(docs).select("text_key", "text")
    several = may(F.col("text_key"))
    once = texts.filter(several).groupBy("text_key").agg(F.first("text").alias("text"))
    words = texts.filter(~several).select(F.explode(_words(F.col("text"))).alias("term"))
    words = words.union(once.select(F.explode(_words(F.col("text"))).alias("term")))
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("dt"))


def disclosing_pairs(mentions: DataFrame, counts: DataFrame, texts: int, support: int, generalise: float, scratch: Scratch) -> DataFrame:
    """(text_key, term, share, j, dt) of terms and classes of entities that reach ``generalise`` x IC.

    mentions(text_key, entities, terms) has a row for each different text with entities; share is PMI / IC.
    """
    each = mentions.select("text_key", F.explode("entities").alias("entity"))
    at = F.xxhash64("text_key")
    entities = each.groupBy("entity").agg(F.count(F.lit(1)).alias("de"), F.bit_xor(at).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), at)).alias("y"))
    classes = each.join(entities, "entity").groupBy("text_key").agg(F.collect_set(F.struct("de", "x", "y")).alias("classes"))
    n = float(texts)
    words = mentions.select("text_key", F.explode("terms").alias("term")).join(counts, "term")
    reach = lambda c: F.col("dt") <= F.lit(n + 1) * F.pow(c["de"] / F.lit(n), F.lit(generalise)) * (1 + 1e-9)
    met = words.join(classes, "text_key").select("text_key", "term", "dt", F.explode(F.filter("classes", reach)).alias("c"))
    pairs = scratch.save(met.select("text_key", "term", "dt", "c.*"), "pairs")
    joint = pairs.groupBy("term", "de", "x", "y").agg(F.count(F.lit(1)).alias("j"), F.first("dt").alias("dt"))
    more = F.when(F.col("j") < support, 1).otherwise(0)
    share = F.log(F.col("j") * (n + more) / (F.col("de") * (F.col("dt") + more))) / F.log(n / F.col("de"))
    told = joint.withColumn("share", F.when(F.col("de") < n, share).otherwise(F.lit(0.0))).filter(F.col("share") >= generalise)
    out = scratch.save(pairs.join(told.select("term", "de", "x", "y", "share", "j"), ["term", "de", "x", "y"]).select("text_key", "term", "share", "j", "dt"), "told")
    scratch.drop(pairs)
    return out


def term_spans(docs: DataFrame, found: DataFrame, support: int, generalise: float, remove: float, elsewhere: float, scratch: Scratch) -> DataFrame:
    """(text_key, terms): array of (start, end, label) for every text with disclosing terms."""
    keys = scratch.save(found.groupBy("text_key").agg(F.count(F.lit(1)).alias("n")), "keys")
    base = F.array_sort(F.concat(*[F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in KINDS]))
    entities = F.array_distinct(F.flatten(F.array(*[_entities(k) for k in KINDS])))
    private = found.filter("held is not null").select("text_key", entities.alias("entities"), _replaced(F.col("held"), base, _blank).alias("masked"))
    private = private.groupBy("text_key").agg(F.first("entities").alias("entities"), F.first("masked").alias("masked"))
    private = scratch.save(private.select("*", _words(F.col("masked")).alias("terms")), "private")
    told = disclosing_pairs(private.select("text_key", "entities", "terms"), document_counts(docs, keys), keys.count(), support, generalise, scratch)
    scratch.drop(keys)

    open_terms = scratch.save(told.filter((F.col("j") >= support) & (F.col("j") >= elsewhere * F.col("dt"))).groupBy("term").agg(F.max("share").alias("share")), "open")
    marks = told.select("text_key", "term", "share").union(private.select("text_key", F.explode("terms").alias("term")).join(open_terms, "term").select("text_key", "term", "share"))
    grouped = lambda x: x.groupBy("text_key", "term").agg(F.max("share").alias("share")).groupBy("text_key").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("marks"))
    marks = grouped(marks)
    spots = _located(F.col("masked"), _WORD, lambda x: F.map_contains_key(F.col("marks"), F.lower(x)))
    label = lambda s: F.when(F.col("marks")[F.lower(s["value"])] >= remove, F.lit("")).when(s["value"].rlike(r"^\p{Lu}"), F.lit("<NAME>")).otherwise(F.lit("<TERM>"))
    spans = F.transform(spots, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), label(s).alias("label")))
    located = lambda held, marks: held.join(marks, "text_key").select("text_key", spans.alias("terms"))
    out = located(private.select("text_key", "masked"), marks)
    if n := open_terms.count():
        texts = _texts(docs)
        words = texts.select("text_key", F.explode(_words(F.col("text"))).alias("term")).filter(bitmap(open_terms, "term", n)(F.col("term"))).distinct()
        seen = words.join(open_terms, "term").join(private.select("text_key"), "text_key", "left_anti")
        seen = scratch.save(seen.select("text_key", "term", "share"), "seen")
        met = seen.select("text_key").distinct()
        held = texts.filter(bitmap(met, "text_key", met.count())(F.col("text_key"))).groupBy("text_key").agg(F.first("text").alias("masked"))
        out = out.union(located(held, grouped(seen)))
    return out


def find_pii(docs: DataFrame, support: int = 3, generalise: float = 0.85, remove: float = 0.98, elsewhere: float = 0.5, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, text_key, email, ip, card, phone, terms) for every row of docs.

    email to phone are arrays of (start, end, value), terms of (start, end, label). Null texts
    are empty and have no spans; repeated rows each get a row, texts in common count once;
    a null doc_id is kept; an empty table gives an empty result; other columns are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession, "pii")
    found = scratch.save(detect(docs), "found")
    terms = scratch.save(term_spans(docs, found, support, generalise, remove, elsewhere, scratch), "terms")
    none = F.array().cast("array<struct<start:bigint,end:bigint,label:string>>")
    return found.drop("held").join(terms, "text_key", "left").select("doc_id", "text_key", *KINDS, F.coalesce("terms", none).alias("terms"))


def span_text(parts: dict[str, Column]) -> Column:
    """kind:start:end of every span, kinds in the given order, comma-joined."""

    def said(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    return F.array_join(F.concat(*[said(k, c) for k, c in parts.items()]), ",")


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """docs with every span of its texts replaced: entities by their kind, terms generalised or removed.

    Overlapping spans are replaced once, by the first one's label. Null texts stay null.
    """
    scratch = options.pop("scratch", None) or Scratch(docs.sparkSession, "pii")
    found = find_pii(docs.select("doc_id", "text"), scratch=scratch, **options)
    all_spans = F.array_sort(F.concat(*[_labelled(k) for k in KINDS], F.col("terms")))
    hit = found.select("text_key", all_spans.alias("_spans")).filter(F.size("_spans") > 0)
    hit = scratch.save(hit.groupBy(F.col("text_key").alias("_key")).agg(F.first("_spans").alias("_spans")), "hits")
    names = docs.columns
    keyed = docs.select(F.struct(*names).alias("_row"), _text_key(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_k2"))
    met = keyed.join(hit, F.col("_k2") == F.col("_key"), "left")
    text = F.col("_row.text").cast("string")
    clean = _replaced(text, F.col("_spans"), lambda s, at: F.when(s["start"] >= at, s["label"]).otherwise(F.lit("")))
    fixed = F.when(F.col("_spans").isNull(), text).otherwise(clean)
    return met.select(*[fixed.alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in names])
