import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha beta gamma delta " * 3000
ODD = [
    (1, None),
    (2, ""),
    (3, LONG),
    (4, LONG),
    (5, "tie"),
    (6, "tie"),
    (6, "tie"),
    (7, "ünï cödé 日本語 🎉 \x00\x1c x"),
    (None, "no id"),
    (None, None),
    (9, " \t\n"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and further columns with names that operators use."""
    rows = [(i, t, None, "s", 1, "clash", 7, "x", [1]) for i, t in ODD]
    return spark.createDataFrame(rows, DDL + ", score string, fp int, place string, spans array<int>").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
