import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names operators use inside."""
    long_text = "alpha beta gamma delta " * 20_000
    rows = [
        (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "  \n ", None, None, None), (4, "12345 !!", "en", "s", 8),
        (5, long_text, "en", "s", len(long_text)), (6, "one two three", "en", "s", 13), (6, "one two three", "en", "s", 13),
        (None, "some text without an id", "en", "s", 23), (7, "one two three", None, "s", 13),
    ]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "1 as node", "'x' as fp", "2 as item", "3 as u", "4 as v", "5 as grp", "'k' as anchor", "7 as length")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
