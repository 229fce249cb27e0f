import math

import numpy as np
import pytest
from pyspark.sql import types as T

from quillforge.llm.nearest import VpTree, calibrate, distances, nearest, nearest_query

SCHEMA = T.StructType([T.StructField("rank", T.StringType()), T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])


def brute(ids, x, q, k):
    d = distances(x[q], x)
    d[np.arange(len(q)), q] = np.inf
    order = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :k]
    return [[(int(ids[j]), float(d[i, j])) for j in row if np.isfinite(d[i, j])] for i, row in enumerate(order)]


def test_factor_one_is_exact_and_production_recall():
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(4000, 24)), 1)  # rounding makes ties
    x[100:160] = x[7]
    ids = rng.permutation(4000)
    q = np.flatnonzero(ids % 100 == 0)
    want = brute(ids, x, q, 10)
    tree = VpTree(ids, x)
    best, who = tree.search(ids[q], x[q], 10, 1.0)
    assert [[(int(w), float(b)) for w, b in zip(*r, strict=True)] for r in zip(who, best, strict=True)] == want
    _, who = tree.search(ids[q], x[q], 10, calibrate(ids, x))
    recall = np.mean([len(set(w.tolist()) & {i for i, _ in t}) / 10 for w, t in zip(who, want, strict=True)])
    assert recall >= 0.9


@pytest.mark.parametrize("shard_rows,query_rows", [(10_000, 10_000), (40, 3)])
def test_frame_against_brute_force(spark, shard_rows, query_rows):
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 4, size=(300, 4)).astype(np.float32)
    x[50:150] = x[50]
    bad = [("r", 1000, None), ("r", 1100, []), ("r", 1200, [0.0] * 4), ("r", 1300, [1.0, None, 0.0, 0.0]), ("r", 1400, [1.0, math.nan, 0.0, 0.0]), ("r", 1500, [1.0, math.inf, 0.0, 0.0]), ("r", None, [1.0, 1.0, 1.0, 1.0])]
    frame = spark.createDataFrame([("r", i, v.tolist()) for i, v in enumerate(x)] + bad, SCHEMA)
    got = nearest(frame, frame.where("vec_id % 100 = 0"), factor=1.0, shard_rows=shard_rows, query_rows=query_rows).orderBy("query_id", "rank").collect()
    live = np.flatnonzero((x != 0).any(1))
    q = np.flatnonzero(live % 100 == 0)
    want = brute(live, x[live].astype(float), q, 10)
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(int(live[i]), k + 1, v, s) for i, row in zip(q, want, strict=True) for k, (v, s) in enumerate(row)]


def test_few_and_no_rows(spark):
    few = spark.createDataFrame([("r", 0, [1.0, 2.0]), ("r", 1, [1.0, 3.0]), ("r", 0, [1.0, 2.0])], SCHEMA)
    assert [(r["query_id"], r["vec_id"], r["rank"]) for r in nearest(few, few.where("vec_id = 0")).collect()] == [(0, 1, 1)]
    none = spark.createDataFrame([], SCHEMA)
    assert nearest(none, none).count() == 0
    assert nearest(few, none).count() == 0


def test_recall_and_share_on_embeddings(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = frame.orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    q = np.flatnonzero(ids % 100 == 0)
    want = {int(ids[i]): {v for v, _ in row} for i, row in zip(q, brute(ids, x, q, 10), strict=True)}
    hits = {i: 0 for i in want}
    for r in nearest_query(frame).collect():
        hits[r["query_id"]] += r["vec_id"] in want[r["query_id"]]
    assert sum(hits.values()) / (10 * len(hits)) >= 0.95
    factor = calibrate(ids, x)
    tree = VpTree(ids, x)
    tree.search(ids[q], x[q], 10, factor)
    assert factor > 1 and tree.visited < 0.97 * len(q) * len(x)  # random directions in 64 dimensions: little to prune


def test_clusters_prune_whole_cells():
    from quillforge.llm import nearest as nn

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16)) * 20
    x = centres[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 16))
    ids = np.arange(4000)
    factor = calibrate(ids, x)
    tree = nn.VpTree(ids, x)
    q = np.arange(0, 4000, 100)
    _, who = tree.search(q, x[q], 10, factor)
    want = brute(ids, x, q, 10)
    assert np.mean([len(set(w.tolist()) & {i for i, _ in t}) / 10 for w, t in zip(who, want, strict=True)]) >= 0.95
    assert tree.visited < 0.2 * len(q) * len(x)
