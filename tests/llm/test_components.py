import pytest

from quillforge.llm.components import components


def test_too_few_rounds_are_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(100)], "a long, b long")
    with pytest.raises(RuntimeError):
        components(chain, rounds=1)
    got = components(chain).collect()
    assert len(got) == 101 and {r["component"] for r in got} == {0}


def test_no_edges(spark):
    assert components(spark.createDataFrame([(None, 1), (2, 2)], "a long, b long"), rounds=1).count() == 0
