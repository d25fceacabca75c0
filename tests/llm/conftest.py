import pytest

ODD = [None, "", " \n\t ", "one", "the of and", "x" * 5000, "Say it again. " * 3000, "Zażółć gęślą jaźń \U0001f600 naïve", "12 34", "a@b.co"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, None if t is None else len(t), "clash", 1.5, "x") for i, t in enumerate(ODD * 2)]
    rows += [rows[3], rows[3], rows[9], (None, "no id here at all", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, score double, shard string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
