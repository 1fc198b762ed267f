import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def documents(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and columns whose names operators use themselves."""
    long = " ".join(f"word{i % 977}" for i in range(40_000))
    base = "the quick brown fox jumps over the lazy dog and runs far away from the old stone house on the hill " * 3
    rows = [
        (1, base, "en", "a", 300), (2, base + "again", "en", "a", None), (2, base + "again", "en", "a", None), (3, None, None, None, None), (4, "", "de", "b", 0),
        (5, " \t\n\x0b\x0c\r ", "de", "b", 7), (6, "Word", "en", "c", 4), (7, "two WORDS", "en", None, 9), (8, long, "en", "d", len(long)), (9, long + " end", "en", "d", 1),
        (None, base, "en", "a", 1), (None, None, None, None, None), (10, "é" * 60 + " 日本語 " + "é" * 60, "fr", "e", 3), (11, base.upper(), "en", "e", 3), (12, "x" * 300, "en", "a", 1), (13, "x" * 299, "en", "zz", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("fp", "row", "rank", "size", "copies", "spans", "_n", "_src", "shard", "kind", "blob", "target", "severity", "deal", "component_id", "id"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="session")
def no_documents(documents):
    return documents.filter("false")


@pytest.fixture(scope="session")
def real(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
