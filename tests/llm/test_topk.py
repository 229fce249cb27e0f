import math
import random

import pytest

from quillforge.llm import topk


def plain(rows, queries, k):
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in queries:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(64 * x) for x in v]
            asked[i] = min(asked.get(i, w), w)
    out = set()
    for q, w in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(w, v)), i) for i, v in whole if i != q)
        out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1.0, 7) for i, v in rows], "vec_id long, embedding array<double>, score string, rank double, shard long")


def collected(df):
    rows = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("shard_rows, query_rows", [(8192, 8192), (50, 7)])
def test_against_all_scores(spark, shard_rows, query_rows):
    rng = random.Random(2)
    rows = [(i, [rng.choice([0.0, 0.01, rng.gauss(0, 0.3)]) for _ in range(12)]) for i in range(260)]
    rows += [(i, rows[3][1]) for i in range(300, 360)]  # ties across the border of the best twenty
    rows += [(400, None), (None, [1.0] * 12), (401, [1.0] * 11 + [None]), (402, [math.nan] * 12), (403, [math.inf] * 12), (404, [0.0] * 12), (405, []), (406, [2.0] * 3), (407, [1.5] * 20)]
    rows += [rows[0], rows[0], (0, [0.5] * 12)]
    queries = [r for r in rows if r[0] is not None and r[0] % 20 == 0] + [(405, []), (407, [1.5] * 20)]
    for k in (20, 1, 500):
        got = collected(topk.top_k(frame(spark, rows), frame(spark, queries), k, shard_rows, query_rows))
        assert got == plain(rows, queries, k)
    assert collected(topk.topk_query(frame(spark, rows))) == plain(rows, [r for r in rows if r[0] is not None and r[0] % 20 == 0], 20)


def test_large_weights_stay_exact(spark):
    rows = [(i, [(1 << 24) * 1.0 + i, 3.0 * (i % 5), -(2.0**23)]) for i in range(40)]
    assert collected(topk.topk_query(frame(spark, rows))) == plain(rows, [r for r in rows if r[0] % 20 == 0], 20)
    with pytest.raises(Exception, match="64 bits"):
        topk.topk_query(frame(spark, [(0, [2.0**40]), (1, [2.0**40])])).collect()


def test_empty_tables(spark):
    nothing = frame(spark, [])
    assert topk.topk_query(nothing).count() == 0
    assert topk.top_k(nothing, frame(spark, [(20, [1.0])])).count() == 0
    assert topk.topk_query(frame(spark, [(20, [1.0])])).count() == 0
