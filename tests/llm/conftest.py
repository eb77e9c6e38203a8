import pytest
from pyspark.sql import Row

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, ties, and extra columns whose names operators use themselves."""
    long = "word " * 30_000
    rows = [(1, "a b c d e"), (2, None), (3, ""), (4, "a b c d e"), (4, "a b c d e"), (None, "a b c d e"), (None, None), (5, long), (6, " \t\n"), (7, "é ü 日本 😀 x"), (8, "mail me@x.org now"), (9, "\u0000 nul")]
    return spark.createDataFrame([Row(doc_id=i, text=t, lang="en", source=None if n % 3 == 0 else f"s{n % 2}", n_chars=None, score=1.0, node=2, size="x", component_id=3, token="t", count=9) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, score double, node long, size string, component_id long, token string, count long")


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")
