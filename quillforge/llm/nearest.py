"""Approximate nearest neighbours: vantage-point trees per shard.

A bounded sample of rows serves as pivots; a row lies in the cell of its nearest pivot, and a cell of many rows is
split into shards by a hash of the ids, so a group of equal vectors of any size is spread evenly. Each shard builds a
vantage-point tree; a block of queries goes down the tree together. A far side is
searched while |d - radius| * factor <= the query's distance to its k-th neighbour so
far: factor 1 is exact by the triangle inequality, a larger factor prunes more.

A query first searches its own cell. The distance to its k-th neighbour there bounds what other cells can add: a
cell is searched if (distance to its pivot - its radius) * factor <= that bound, so whole shards fall away by the same rule.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillforge.llm.stages import settle

SHARD_ROWS = 16_384
QUERY_ROWS = 16_384
#: Rows to a pivot, about, and the most pivots (512 bytes each at 64 dimensions); they are a sample by a hash of the ids.
PIVOT_ROWS, PIVOTS = 1024, 256
LEAF = 96
#: Relaxations to choose from, and the sample (rows, queries) and the recall on it by which one is chosen.
FACTORS = (8.0, 6.0, 5.0, 4.0, 3.0, 2.0, 1.5, 1.0)
CALIBRATION_ROWS, CALIBRATION_QUERIES, CALIBRATION_RECALL = 4096, 64, 0.99
K = 10


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, from differences: (len(a), len(b))."""
    diff = a[:, None, :] - b[None, :, :]
    return np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))


class VpTree:
    """A vantage-point tree over ``x`` (n, d) with ids; built without recursion limits in mind: depth is log2(n / LEAF)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF, seed: int = 3):
        self.ids, self.x, self.leaf = ids, x, leaf
        self.visited = 0
        self.root = self._build(np.arange(len(ids)), np.random.default_rng(seed))

    def _build(self, rows: np.ndarray, rng: np.random.Generator):
        if len(rows) <= self.leaf:
            return rows
        pick = rng.integers(len(rows))
        vantage, rest = rows[pick], np.delete(rows, pick)
        diff = self.x[rest] - self.x[vantage]
        d = np.sqrt(np.einsum("ij,ij->i", diff, diff))
        radius = float(np.median(d))
        near = d < radius
        if not near.any():  # half the rows or more lie at one distance: no radius below it parts them
            near = d <= radius
            if near.all():
                return rows
            radius = float(d[~near].min())
        return vantage, radius, self._build(rest[near], rng), self._build(rest[~near], rng)

    def search(self, qids: np.ndarray, q: np.ndarray, k: int, factor: float, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Distances and ids of the k best rows of each query, its own id left out; inf and -1 fill up.

        ``bound``: distances beyond which nothing is wanted (rows beyond them may be given all the same).
        """
        self.bound = np.full(len(q), np.inf) if bound is None else bound
        self.best = np.full((len(q), k), np.inf)
        self.who = np.full((len(q), k), np.iinfo(np.int64).max)
        self.qids, self.q, self.k, self.factor = qids, q, k, factor
        if len(q) and len(self.ids):
            self._down(self.root, np.arange(len(q)))
        return self.best, np.where(np.isinf(self.best), -1, self.who)

    def _offer(self, active: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
        d = np.where(ids[None, :] == self.qids[active][:, None], np.inf, d)
        use = d.min(1) <= self._reach(active)
        if not use.any():
            return
        active, d = active[use], d[use]
        alld = np.hstack([self.best[active], d])
        allid = np.hstack([self.who[active], np.broadcast_to(ids, d.shape)])
        order = np.lexsort((allid, alld), axis=1)[:, : self.k]
        self.best[active] = np.take_along_axis(alld, order, 1)
        self.who[active] = np.take_along_axis(allid, order, 1)

    def _reach(self, active: np.ndarray) -> np.ndarray:
        return np.minimum(self.best[active, -1], self.bound[active])

    def _down(self, node, active: np.ndarray) -> None:
        if isinstance(node, np.ndarray):
            if len(node):
                for a in range(0, len(active), 256):
                    for b in range(0, len(node), 1024):
                        part, rows = active[a : a + 256], node[b : b + 1024]
                        self.visited += len(part) * len(rows)
                        self._offer(part, distances(self.q[part], self.x[rows]), self.ids[rows])
            return
        vantage, radius, near, far = node
        d = distances(self.q[active], self.x[[vantage]])
        self._offer(active, d, self.ids[[vantage]])
        d = d[:, 0]
        inside = d < radius
        for first, second, mine in ((near, far, inside), (far, near, ~inside)):
            if mine.any():
                self._down(first, active[mine])
                gap = np.abs(d[mine] - radius) * self.factor
                left = gap <= self._reach(active[mine])
                if left.any():
                    self._down(second, active[mine][left])


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id long, embedding array<double>) of rows that take part: id there, some component not 0, all finite and not null."""
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return kept.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda v: v != 0))


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    column = table.column("embedding").combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    ids = table.column("vec_id").to_numpy()
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
    order = np.lexsort((*x.T[:1], ids))  # the tree doesn't depend on the order of arrival
    return ids[order].astype(np.int64), x[order].astype(np.float64)


def _pivots(good: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Pivots by length of vector: about one for ``PIVOT_ROWS`` rows, ``PIVOTS`` at most, those with the smallest hash of their id."""
    count = min(PIVOTS, math.ceil(n / PIVOT_ROWS))
    rows = good.orderBy(F.xxhash64("vec_id", F.lit(41)), "vec_id").limit(count).select("embedding").collect()
    found: dict[int, list] = {}
    for r in rows:
        found.setdefault(len(r[0]), []).append(r[0])
    return {dim: np.array(v, np.float64) for dim, v in found.items()}


def _by_cell(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``rows`` (vec_id, embedding) with dim, cell (of the nearest pivot of that length, 0 without one) and the distance to its pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array([len(v) for v in batch.column(1)], np.int64)
            cell, far = np.zeros(len(dims), np.int64), np.full(len(dims), np.inf)
            for dim in np.unique(dims):
                if int(dim) in pivots:
                    at = np.flatnonzero(dims == dim)
                    x = batch.column(1).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
                    for a in range(0, len(at), 1024):
                        d = distances(x[a : a + 1024], pivots[int(dim)])
                        cell[at[a : a + 1024]], far[at[a : a + 1024]] = d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims.astype(np.int32)), pa.array(cell), pa.array(far)], names=["vec_id", "embedding", "dim", "cell", "far"])

    return rows.mapInArrow(run, "vec_id long, embedding array<double>, dim int, cell long, far double")


def _others(queries: DataFrame, pivots: dict[int, np.ndarray], radius: dict[tuple[int, int], float], factor: float) -> DataFrame:
    """(query row, other cell) for each cell that may hold something nearer than the query's bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, own, bound = (batch.column(c).to_numpy() for c in ("dim", "cell", "bound"))
            rows, cells = [], []
            for dim in np.unique(dims):
                if int(dim) not in pivots:
                    continue
                reach = np.array([radius.get((int(dim), c), -np.inf) for c in range(len(pivots[int(dim)]))])
                at = np.flatnonzero(dims == dim)
                x = batch.column("embedding").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
                for a in range(0, len(at), 1024):
                    part = at[a : a + 1024]
                    gap = np.maximum(0.0, distances(x[a : a + 1024], pivots[int(dim)]) - reach)
                    i, c = np.nonzero((gap * factor <= bound[part][:, None]) & (np.arange(len(reach)) != own[part][:, None]) & (reach >= 0))
                    rows.append(part[i])
                    cells.append(c)
            if rows:
                pick = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pick) for c in ("vec_id", "embedding", "dim", "bound")), pa.array(np.concatenate(cells).astype(np.int64))], names=["vec_id", "embedding", "dim", "bound", "cell"])

    return queries.select("vec_id", "embedding", "dim", "bound", "cell").mapInArrow(run, "vec_id long, embedding array<double>, dim int, bound double, cell long")


def calibrate(ids: np.ndarray, x: np.ndarray, k: int = K) -> float:
    """The largest of ``FACTORS`` whose recall among these rows, against brute force, is ``CALIBRATION_RECALL`` or more."""
    if len(x) <= k:
        return 1.0
    q = np.unique(np.linspace(0, len(x) - 1, CALIBRATION_QUERIES).astype(np.int64))
    d = np.concatenate([distances(x[[i]], x) for i in q])
    d[np.arange(len(q)), q] = np.inf
    kth = np.partition(d, k - 1, axis=1)[:, k - 1]
    tree = VpTree(ids, x)
    for factor in FACTORS:
        best, _ = tree.search(ids[q], x[q], k, factor)
        if np.mean(best <= kth[:, None]) >= CALIBRATION_RECALL:
            return factor
    return 1.0


def _calibrated(good: DataFrame, k: int) -> float:
    """``calibrate`` on the rows with the smallest seeded hash of their id, those of the commonest length among them."""
    rows = good.orderBy(F.xxhash64("vec_id", F.lit(43)), "vec_id").limit(CALIBRATION_ROWS).collect()
    if not rows:
        return 1.0
    dims = np.array([len(r["embedding"]) for r in rows])
    keep = [r for r, dim in zip(rows, dims, strict=True) if dim == np.bincount(dims).argmax()]
    return calibrate(np.arange(len(keep)), np.array([r["embedding"] for r in keep], np.float64), k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, factor: float | None = None, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The k nearest rows of ``vectors`` for each row of ``queries``: query_id, rank, vec_id, score.

    Both have vec_id and embedding; extra columns are dropped. Vectors that are null, empty,
    zero or not finite take no part, nor do rows without an id. A candidate with the
    query's own id is left out. Vectors are compared with those of their own length
    only. Repeated query rows count once. Ties go to the smaller vec_id. Empty tables give no rows.
    Without a ``factor`` the largest one is taken that keeps a recall of ``CALIBRATION_RECALL`` on a sample of
    ``CALIBRATION_ROWS`` rows; every row is searched all the same. What reaches the driver is the sample, the pivots and one row for each cell.
    """
    good = usable(vectors)
    factor = _calibrated(good, k) if factor is None else factor
    asked = usable(queries).dropDuplicates(["vec_id"])
    pivots = _pivots(good, good.count())
    placed = settle(_by_cell(good, pivots))
    cells = placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
    known = cells.where(F.col("dim").isin(list(pivots))).collect() if pivots else []  # a row for each pivot
    radius = {(r["dim"], r["cell"]): r["radius"] for r in known}
    shards = cells.select("dim", "cell", F.ceil(F.col("n") / shard_rows).cast("long").alias("shards"))
    rows = placed.join(shards, ["dim", "cell"]).withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")))
    wanted = settle(_by_cell(asked, pivots))
    keys = ["dim", "cell", "shard", "block"]

    def search(key, data: pa.Table, asks: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not len(data) or not len(asks):
            return empty
        tree = VpTree(*_matrix(data))
        asks = asks.take(pa.array(np.argsort(asks.column("vec_id").to_numpy(), kind="stable")))
        qids, q = _matrix(asks)
        best, who = tree.search(qids, q, k, factor, asks.column("bound").to_numpy())
        row, col = np.nonzero(~np.isinf(best))
        return pa.table({"query_id": qids[row], "vec_id": who[row, col], "score": best[row, col]})

    def found(asks: DataFrame) -> DataFrame:
        """What ``asks`` find in their cells. A cell's rows are copied once for each block of ``query_rows`` that ask it, and not at all if none does."""
        cell_blocks = settle(asks.groupBy("dim", "cell").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("blocks")))
        left = rows.join(cell_blocks, ["dim", "cell"]).select("vec_id", "embedding", "dim", "cell", "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("blocks")).cast("int").alias("block")
        placed_asks = asks.join(shards, ["dim", "cell"]).join(cell_blocks, ["dim", "cell"])
        right = placed_asks.select("vec_id", "embedding", "bound", "dim", "cell", block, F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"))
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double")

    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = lambda rows: rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    first = settle(best(found(wanted.withColumn("bound", F.lit(float("inf"))))))
    kth = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    bounded = wanted.join(kth, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    more = found(settle(_others(bounded, pivots, radius, factor)))
    return best(first.drop("rank").unionByName(more)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest_query(vectors: DataFrame) -> DataFrame:
    """The ten nearest of every row whose vec_id is divisible by 100, against all other rows; awkward rows as ``nearest`` says."""
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))
