import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, `row` int"
BODY = "The quick brown fox jumps over the lazy dog near the old river bank while seven small birds sing loudly in the tall green trees above them today"


def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows; two columns with clashing names."""
    rows = [
        (1, BODY, "en", "a", None, "x", 1),
        (2, BODY + " indeed", "en", "b", 5, "x", 1),
        (2, BODY + " indeed", "en", "b", 5, "x", 1),
        (3, None, "en", "a", None, None, None),
        (4, "", None, None, 0, None, None),
        (5, " \t\n ", "fr", "c", 3, None, 2),
        (None, "no id but some words here", None, None, None, None, None),
        (None, None, None, None, None, None, None),
        (6, "word " * 30_000, "en", "a", 150_000, None, None),
        (7, "héé ñ 日本 語 \U0001f600 ﬀ x", "fr", "z", None, "y", 3),
        (8, BODY.upper(), "en", "b", None, "x", 1),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
