import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, one id twice, and columns of clashing names."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
    rows = [
        (1, "a b c d e f g h i j k l m n o p", "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "a b c d e f g h i j k l m n o p", "en", None, 2), (4, long, "en", "t", 3),
        (5, "a b c d e f g h i j k l m n o p", "en", "s", 1), (5, "a b c d e f g h i j k l m n o p", "en", "s", 1), (6, "x", "fr", "", 1), (6, "other text with one id", "fr", "t", 1), (7, " \n\t ", "de", "s", 3), (8, "token = \"abcdef\" \U0001f600 AKIA" + "Z" * 20, "es", "s", 9),
    ]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit(1) for c in ("hash", "place", "base", "size", "row", "shard", "score", "print", "sketch", "key", "range", "spans", "hits", "value", "_t")})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
