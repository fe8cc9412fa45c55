import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCUMENT = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("text", StringType()),
        StructField("lang", StringType()),
        StructField("source", StringType()),
        StructField("n_chars", LongType()),
        StructField("key", StringType()),  # clashes with names used inside the operators
    ]
)


@pytest.fixture(scope="session")
def documents(spark):
    def make(texts, langs=None, sources=None):
        rows = [
            (i, t, (langs or {}).get(i, "en"), (sources or {}).get(i, "s"), len(t or ""), "k")
            for i, t in texts
        ]
        return spark.createDataFrame(rows, DOCUMENT)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and white space, one word, ties, repeated rows, a very long text."""
    return [
        (1, None),
        (2, ""),
        (3, " \t\n"),
        (4, "word"),
        (5, "same text here twice."),
        (6, "same text here twice."),
        (6, "same text here twice."),
        (7, "A first line.\nÜber straße 😀 naïve\x85x y.\n" * 30),
        (8, "lorem ipsum dolor sit amet " * 20_000),
        (None, "without an id"),
    ]
