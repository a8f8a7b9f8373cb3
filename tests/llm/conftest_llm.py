import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001"

PROSE = (
    "Slow rivers carve the valley floor and leave gravel bars behind them. Herons wait on the bars until the water clears, "
    "then wade out along the shallow edge. In spring the melt brings silt from the upper slopes, and the colour of the stream "
    "turns from green to a pale brown that lasts for weeks."
)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    rows = [
        (None, PROSE, "en", "a", 1), (None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", "a", 0),
        (3, " \t\r\n ", None, "b", 5), (4, PROSE, "en", None, 9), (4, PROSE, "en", None, 9), (5, PROSE, "en", "a", 9),
        (6, "one", "en", "a", 3), (7, "naïve café 日本 😀 Ünï", "fr", "a", 9), (8, (PROSE + "\n") * 400, "en", "c", 1),
        (9, "x" * 50_000, "en", "c", 1), (4, "another text with the same id", "en", "a", 2), (10, "mail a.b@example.org now", "en", "a", 2),
    ]
    names = ["id", "key", "kept", "base", "size", "source_size", "component", "digest", "n_words", "scores", "part", "name", "_rank"]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", *[f"'clash' AS {n}" for n in names])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}
