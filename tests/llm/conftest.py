import pytest

from pyspark.sql import types as T

#: documents with clashing and extra columns; ids out of order, null and doubled, texts null, empty and equal.
SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("source", T.StringType()), ("doc_id", T.LongType()), ("text", T.StringType()), ("score", T.DoubleType()), ("shard", T.LongType()), ("size", T.StringType()), ("lang", T.StringType()))])


def rows(texts, first=1):
    return [("s%d" % (i % 3) if i % 5 else None, first + i, t, 0.5, 7, "x", "en") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def make(spark):
    def build(data):
        return spark.createDataFrame(data, SCHEMA)

    return build


@pytest.fixture(scope="session")
def awkward(make):
    """Nulls in every column, empty and blank texts, ties, repeated rows, one very long text."""
    long = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
    data = rows([None, "", "   ", "one", "one two", "one two", long, "Ünïcode wörds ſ \u212a K İ", "it's '' x"])
    data += [(None, None, None, None, None, None, None), (None, None, "text without id here", None, None, None, None), ("s1", 3, "   ", 0.1, 1, "y", "en"), ("s1", 3, "another row with this id", 0.1, 1, "y", "en")]
    data += [data[4], data[4]]
    return make(data)


@pytest.fixture(scope="session")
def empty(make):
    return make([])
