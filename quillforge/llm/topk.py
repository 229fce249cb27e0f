"""Exact top-k by inner product: exhaustive term-at-a-time accumulation.

A vector is a sparse row of terms: its components are weights, those that are 0 have no posting. Rows are dealt evenly to
shards; each shard keeps, for every term, the rows that have it and their weights. A block of queries is scored against a
shard one term at a time: the term's postings, times the queries' weights of it, are scattered into dense score arrays. Every row is
scored, so nothing is estimated or pruned. A partition step keeps the k best of each query and shard; their union holds
the k best of all.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillforge.llm.stages import settle

K = 20
#: Rows of a shard and queries of a block: what a task holds, whatever the size of the table.
SHARD_ROWS = QUERY_ROWS = 8192
#: Queries that are scored together, so that a dense score array has SHARD_ROWS x QUERIES numbers.
QUERIES = 128
SCALE = 64
FOUND = "query_id long, vec_id long, score long"


def weights(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x), x as double, of each component. A product outside the 64-bit integers is an error (ANSI)."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * scale))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, weights) of the rows that take part: an id, a vector, every component there and finite."""
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return kept.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite).select("vec_id", weights(F.col("v")).alias("weights"))


class Rows:
    """Rows in ascending id as postings: terms ascending, for each the places of the rows that have it and their weights."""

    def __init__(self, table: pa.Table):
        table = table.take(pa.array(np.argsort(table.column("vec_id").to_numpy(), kind="stable")))
        self.ids = table.column("vec_id").to_numpy().astype(np.int64)
        lists = pa.concat_arrays(table.column("weights").chunks) if len(table) else pa.array([], pa.list_(pa.int64()))
        value, size = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(size)), size)
        term = np.arange(len(value)) - np.repeat(np.cumsum(size) - size, size)
        there = np.flatnonzero(value)
        there = there[np.argsort(term[there], kind="stable")]
        self.row, self.value, term = row[there], value[there].astype(np.int64), term[there]
        self.terms, first = np.unique(term, return_index=True)
        self.edges = np.append(first, len(term))
        self.most = int(np.abs(self.value).max(initial=0))
        self.width = int(size.max(initial=0))

    def postings(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.edges[t], self.edges[t + 1]
        return self.row[a:b], self.value[a:b]

    def between(self, a: int, b: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Postings of the rows a to b (counted from a), by term."""
        keep = (self.row >= a) & (self.row < b)
        out = {}
        for t, (lo, hi) in enumerate(zip(self.edges, self.edges[1:], strict=False)):
            mine = np.flatnonzero(keep[lo:hi]) + lo
            if len(mine):
                out[int(self.terms[t])] = (self.row[mine] - a, self.value[mine])
        return out


def accumulate(rows: Rows, asked: dict[int, tuple[np.ndarray, np.ndarray]], n: int, exact: type) -> np.ndarray:
    """Scores (rows, queries): each query weight times the postings of its term, scattered into dense arrays."""
    scores = np.zeros((len(rows.ids), n), exact)
    for t, term in enumerate(rows.terms.tolist()):
        if term in asked:
            at, weight = rows.postings(t)
            query = np.zeros(n, exact)
            query[asked[term][0]] = asked[term][1]
            scores[at] += np.multiply.outer(weight.astype(exact), query)
    return scores


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """True at the k largest of each row of ``scores`` (negative: not wanted); of equal ones the first."""
    k = min(k, scores.shape[1])
    kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k][:, None]
    above, equal = scores > kth, scores == kth
    return above | (equal & (np.cumsum(equal, axis=1, dtype=np.int32) <= k - above.sum(1, keepdims=True)))


def search(data: pa.Table, asks: pa.Table, k: int) -> pa.Table:
    """The k best rows of ``data`` for each query of ``asks``; a row with the query's own id is left out."""
    out: list[list[np.ndarray]] = [[], [], []]
    if len(data) and len(asks):
        rows, queries = Rows(data), Rows(asks)
        bound = rows.most * queries.most * max(1, min(rows.width, queries.width))
        if bound >= 1 << 63:
            raise OverflowError("an inner product may not fit 64 bits")
        exact = np.float64 if bound < 1 << 53 else np.int64  # doubles hold whole numbers below 2 ** 53 exactly
        least = -np.inf if exact is np.float64 else np.iinfo(np.int64).min
        for a in range(0, len(queries.ids), QUERIES):
            ids = queries.ids[a : a + QUERIES]
            scores = np.ascontiguousarray(accumulate(rows, queries.between(a, a + len(ids)), len(ids), exact).T)
            own = rows.ids[None, :] == ids[:, None]
            scores[own] = least
            q, r = np.nonzero(best(scores, k) & ~own)
            for column, values in zip(out, (ids[q], rows.ids[r], scores[q, r].astype(np.int64)), strict=True):
                column.append(values)
    columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
    return pa.table(columns, names=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The k rows of ``vectors`` with the largest inner product with each row of ``queries``: query_id, rank, vec_id, score.

    Both have vec_id and embedding; components become floor(64 * x) and scores are whole numbers, exactly. Vectors that are null or hold
    null or non-finite components take no part, nor do rows without an id; an empty vector has no terms and scores 0; of
    two vectors of unequal length the shorter lacks the other's last terms. A candidate with the query's own id is left out.
    Ties go to the smaller vec_id. Repeated query rows (by id) count once, the one with the smallest vector; repeated candidate rows
    are candidates each. Extra columns are dropped. Empty tables give no rows.

    Rows are dealt to shards by number, not by id, so equal ids or vectors, however many, are spread. A task scores one block of
    queries against one shard; every pair of a block and a shard is a task of the same bounded size.
    """
    rows = settle(usable(vectors).withColumn("number", F.monotonically_increasing_id()))
    asked = usable(queries).groupBy("vec_id").agg(F.min("weights").alias("weights"))
    asked = settle(asked.withColumn("number", F.monotonically_increasing_id()))
    shards, blocks = max(1, math.ceil(rows.count() / shard_rows)), max(1, math.ceil(asked.count() / query_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda n: F.pmod(F.xxhash64("number"), F.lit(n)).cast("int")
    left = rows.select("vec_id", "weights", place(shards).alias("shard"), every(blocks).alias("block"))
    right = asked.select("vec_id", "weights", every(shards).alias("shard"), place(blocks).alias("block"))
    cells = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block"))
    found = cells.applyInArrow(lambda data, asks: search(data, asks, k), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def topk_query(vectors: DataFrame) -> DataFrame:
    """The twenty best of every row whose vec_id is divisible by 20, against all other rows; awkward rows as ``top_k`` says."""
    return top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0))


ORACLE = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
  FROM rows q JOIN rows c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""
