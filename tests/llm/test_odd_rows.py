"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlens.llm import embeddings, lm, lpt, mixing, packing, pii, quality, queries, simhash, spotsigs, warc


def ranker():
    import numpy as np

    x = np.array([quality.text_features(t) for t in ("a good plain text here", "BAD!! $$$ ###", "some more of plain words", "%%% *** !!")])
    return quality.fit(x, np.array([1, 0, 1, 0]))


OPERATORS = {
    "quality": lambda d: quality.score_documents(d, ranker()),
    "pii": pii.find_pii,
    "packing": lambda d: packing.pack_documents(d, queries.vocabulary_path(), capacity=64),
    "lpt": lambda d: lpt.shard_documents(d, 4),
    "simhash": simhash.simhash_groups,
    "wide": simhash.wide_groups,
    "lm": lm.kneser_ney_scores,
    "spotsigs": spotsigs.fingerprint_edits,
    "sanitise": pii.sanitise,
    "keep_good": lambda d: quality.keep_good(d, ranker()),
    "dedup": simhash.near_copy_dedup,
    "mixing": mixing.poisson_mix,
}
ONE_EACH = {"quality", "pii", "lpt", "simhash", "wide", "lm", "spotsigs", "sanitise"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_documents(odd_docs, no_docs, name):
    n = odd_docs.count()
    rows = OPERATORS[name](odd_docs).collect()
    if name in ONE_EACH:
        assert len(rows) == n
        want = collections.Counter(r.doc_id for r in odd_docs.collect())
        assert collections.Counter(r.doc_id for r in rows) == want
    if name == "packing":
        assert collections.Counter(r.doc_id for r in rows if r.start == 0) == collections.Counter(r.doc_id for r in odd_docs.collect())
    if name == "lpt":
        by = collections.defaultdict(list)
        for r in rows:
            by[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in by.values())
    if name in ("quality", "lm", "spotsigs"):
        assert all(v is not None for r in rows for k, v in r.asDict().items() if k != "doc_id")
    if name == "dedup":
        ids = [r.doc_id for r in rows if r.doc_id is not None]
        assert len(ids) == len(set(ids)) and {0, 3, 5, 6, 7} <= set(ids) and not set(ids) & set(range(10, 20))
    if name in ("sanitise", "keep_good", "dedup"):
        assert rows[0].asDict().keys() == set(odd_docs.columns)
    assert OPERATORS[name](no_docs).collect() == []


def test_odd_pages(spark):
    rows = [(1, "http://a", "x"), (2, None, "x"), (3, "http://b\r\nEvil: 1", None), (4, "http://c", ""), (5, "http://d", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"), (6, "ü", "é" * 10000), (6, "ü", "é" * 10000), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit("clash"))
    got = warc.warc_round_trip(pages).collect()
    assert len(got) == len(rows)
    kind = collections.defaultdict(list)
    for r in got:
        kind[r.page_id].append((r.record_type, r.original and r.original.page_id, r.response.payload_bytes))
    assert kind[1] == [("response", None, 1)] and kind[2] == [("revisit", 1, None)] and kind[6] == [("response", None, 20000)] * 2
    assert kind[5] == [("response", None, 33)]
    assert all(r.request is not None and r.metadata is not None for r in got)
    assert warc.warc_round_trip(pages.limit(0)).collect() == []
    assert {r.record_type for r in warc.warc_round_trip(pages.filter("page_id in (1, 2)"), min_revisit_bytes=2).collect()} == {"response"}


def test_names_of_columns_that_operators_use_inside(spark):
    names = ["_by", "_cdf", "_u", "_row", "_t", "_n", "_key", "_spans", "rate", "x y", "key", "rep"]
    rows = [(i, f"a plain text number {i}", "s", *range(len(names))) for i in range(4)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    for f in (mixing.poisson_mix, lambda d: quality.keep_good(d, ranker()), pii.sanitise, simhash.near_copy_dedup):
        out = f(docs)
        assert set(docs.columns) - {"rate"} <= set(out.columns) and all(r["_u"] == 2 and r["x y"] == 9 for r in out.collect())


def test_vectors_of_repeated_ids_and_other_columns(spark):
    rows = [(1, [1.0, 0.0], 1, 5), (1, [0.0, 1.0], 1, 6), (2, [0.0, 1.0], 1, 7), (2, [0.0, 1.0], 1, 7), (None, [0.0, 1.0], 1, 8), (3, [0.0, 1.0], 2, 9)]
    got = embeddings.vector_groups(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, node int")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in got) == [(0, 0, 0), (1, 0, 1), (1, 2, 1), (2, 2, 1), (2, 2, 1), (3, 0, 3)]


def test_archives_of_long_payloads_have_fewer_records(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "FILE_BYTES", 1 << 16)
    monkeypatch.setattr(warc, "FILE_ROWS", 64)
    pages = spark.createDataFrame([(i, "u", f"{i} " + "y" * (10 if i % 3 else 40000 + i)) for i in range(90)], "page_id bigint, url string, html string").coalesce(1)
    warc.write_warc(pages, str(tmp_path / "a"))
    sizes = [f.stat().st_size for f in (tmp_path / "a").glob("part-*")]
    assert len(sizes) >= 31 and max(sizes) < 90000
    got = warc.assemble(warc.read_records(spark, str(tmp_path / "a"))).collect()
    assert sorted(r.page_id for r in got) == list(range(90)) and all(r.response.payload_bytes > 10 for r in got)


def test_clusters_need_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from ledgerlens.llm import common

    conf = SimpleNamespace(get=lambda *a: None)
    fake = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077"), conf=conf)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(fake)


def test_temporary_tables_go(spark):
    import os

    from ledgerlens.llm import common

    with common.temporary():
        scratch = common.Scratch(spark, "gone")
        scratch.save(spark.range(3))
        assert os.path.isdir(lm.local_folder(scratch.base))
    assert not os.path.exists(lm.local_folder(scratch.base))


def test_other_vocabularies_go_through_their_own_tokenizer():
    import numpy as np
    from tokenizers import Tokenizer

    path = queries.vocabulary_path("byte_bpe_50k.json")
    texts = ["Plain words, it's 12", " x\n\ny", ""]
    whole, cached = Tokenizer.from_file(path), packing.WordCachedTokenizer(path)
    assert [np.frombuffer(b, "<u4").tolist() for b in cached.encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert packing.WordCachedTokenizer(queries.vocabulary_path()).known


def test_cut_off_archives_are_errors():
    with pytest.raises(ValueError):
        list(warc.parse_warc(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc"))
    with pytest.raises(ValueError):
        list(warc.parse_warc(b"nonsense\r\n\r\n"))


def test_no_vectors(spark):
    v = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert embeddings.vector_groups(v).collect() == []


def test_one_label_only(spark):
    r = quality.fit(quality.np.ones((3, quality.FEATURES)), quality.np.array([1, 1, 1]))
    assert r.score(quality.np.ones((1, quality.FEATURES))).tolist() == [pytest.approx(0.5)]


def test_mixture_meets_its_weights(spark):
    rows = [(i, "x" * 99, "big" if i < 3000 else "small" if i < 3900 else None) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    weights = spark.createDataFrame([("big", 1.0), ("small", 1.0)], "source string, weight double")
    n = collections.Counter(r.source for r in mixing.poisson_mix(docs, weights=weights).collect())
    assert abs(n["big"] - 2000) < 150 and abs(n["small"] - 2000) < 150 and n[None] == 0
    assert mixing.poisson_mix(docs, seed=3).orderBy("doc_id", "copy_no").collect() == mixing.poisson_mix(docs.repartition(7), seed=3).orderBy("doc_id", "copy_no").collect()


def test_pipeline_stages_on_odd_documents(spark, sf, odd_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, odd_docs, sf)
        if name != "packing":
            assert out.columns == odd_docs.columns
        assert out.count() > 0 and stage(spark, no_docs, sf).count() == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("*", F.lit(1).alias("score"))
    assert corpus_pipeline.keep_quality(spark, docs, sf).columns == docs.columns


def test_pipeline_runs_on_the_small_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in corpus_pipeline.keep_quality(spark, docs, sf).collect()}
    assert sum(d in kept for d, q in labels.items() if q == 1) >= 0.95 * sum(labels.values())
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and {r.doc_id for r in rows} <= kept
