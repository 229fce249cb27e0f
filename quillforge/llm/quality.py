"""Quality classifier: random-indexing word vectors, a two-layer network, calibrated probabilities.

A text is a stream of tokens: runs of letters and digits (letters folded to
lower case for A-Z), runs of other marks, and a few shape tokens (capitals,
digits, a word that repeats the one before). Every token falls into one of
``BUCKETS`` rows by its hash and has a sparse random index vector. A token's word
vector is the sum of the index vectors around it (two on either side), its own
included, over the training sample. A document is the mean of its tokens'
vectors; a two-layer network maps it to a probability, whose temperature is set
on rows kept out of the fit.

The network and the word vectors are fitted on at most ``SAMPLE_ROWS`` labelled
rows (the bound is a parameter); every document is scored from its whole text.
What reaches the driver is BUCKETS x DIM integers and SAMPLE_ROWS x DIM
features, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillforge.llm.columns import U64, WORD_BASE, byte_table, mix, powers, release, rows_of, slices, feature_hash, text_bytes
from quillforge.llm.stages import settle

SAMPLE_ROWS = 12_000
BUCKETS = 1 << 14
DIM = 32
NONZERO = 4
REACH = 2
HIDDEN = 24
THRESHOLD = 0.7
SHAPES = 6
#: Bytes of text that are held as tokens at a time, inside long documents too.
CHUNK = 1 << 18
#: Sampled rows up to which the labels are broadcast (16 bytes each).
BROADCAST_ROWS = 1_000_000

_KIND = np.full(256, 2, np.uint8)
_KIND[[32, 9, 10, 11, 12, 13]] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_TABLE = byte_table(fold=True) * (_KIND > 0).astype(U64)
_NONE = np.zeros(0, U64)


def tokens(data: np.ndarray, offsets: np.ndarray, before: np.ndarray = _NONE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each token, in order, n + 1 token offsets of the rows, and the hashes of the last two tokens.

    ``before`` are the hashes of the two tokens before ``data`` where it continues a document.
    """
    kind = _KIND[data]
    edge = np.ones(len(data), bool)
    edge[1:] = kind[1:] != kind[:-1]
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    cuts = np.append(np.flatnonzero(edge), len(data))
    starts, ends = cuts[:-1], cuts[1:]
    keep = kind[starts] > 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[keep], ends[keep]
    if len(starts) == 1 and ends[0] - starts[0] > CHUNK:
        h = _long_hash(data[starts[0] : ends[0]])
    else:
        h = feature_hash(data, starts, ends, _TABLE)
    bucket = (h & U64(BUCKETS - 1)).astype(np.int32)
    row = np.searchsorted(offsets, starts, side="right") - 1
    first = data[starts] if len(starts) else data[:0]
    second = np.where(ends - starts > 1, data[np.minimum(starts + 1, len(data) - 1)], 0) if len(starts) else data[:0]
    capital = (first >= 65) & (first <= 90)
    past, k = np.concatenate([before, h]), len(before)
    there = np.concatenate([np.zeros(k, row.dtype), row])
    again = np.zeros(len(past), bool)
    again[1:] = (past[1:] == past[:-1]) & (there[1:] == there[:-1])
    again[2:] |= (past[2:] == past[:-2]) & (there[2:] == there[:-2]) & (np.concatenate([np.zeros(k, np.uint8), kind[starts]])[2:] == 1)
    again = again[k:]
    shape = np.where(again, 0, np.where(capital & (second >= 65) & (second <= 90), 1, np.where(capital, 2, np.where((first >= 48) & (first <= 57), 3, np.where((_KIND[first] == 2) & (ends - starts > 1), 4, 5)))))
    both = np.empty(2 * len(bucket), np.int32)
    both[0::2], both[1::2] = bucket, BUCKETS + shape
    return both, 2 * np.searchsorted(row, np.arange(len(offsets))), past[-2:]


def _long_hash(data: np.ndarray) -> np.ndarray:
    """``feature_hash`` of one token longer than a chunk, summed chunk by chunk."""
    total, mask = 0, (1 << 64) - 1
    for a in range(0, len(data), CHUNK):
        part = _TABLE[data[a : a + CHUNK]]
        total += int((part * powers(WORD_BASE, len(part))).sum(dtype=U64)) * pow(WORD_BASE, a, 1 << 64)
    return mix(np.array([(total + len(data) * 0x9E3779B97F4A7C15) & mask], U64))


def token_chunks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool]]:
    """(first row, row after the last, buckets, token offsets, whether the chunk goes on with the row before it).

    Chunks hold about ``CHUNK`` bytes: several short rows, or a part of a long one that ends between two tokens. Where
    a long row is cut depends on that row alone.
    """
    for a, b in slices(offsets, CHUNK):
        lo, hi = int(offsets[a]), int(offsets[b])
        if hi - lo <= CHUNK:
            yield (a, b, *tokens(data[lo:hi], offsets[a : b + 1] - lo)[:2], False)
            continue
        at, before = lo, _NONE
        while at < hi:
            end = _between(data, at, hi)
            bucket, places, before = tokens(data[at:end], np.array([0, end - at]), before)
            yield a, b, bucket, places, at > lo
            at = end


def _between(data: np.ndarray, at: int, hi: int) -> int:
    """The last place between two tokens in the next ``CHUNK`` bytes; the end of the token where there is none."""
    end = min(hi, at + CHUNK)
    if end == hi:
        return hi
    kind = _KIND[data[at : end + 1]]
    change = np.flatnonzero(kind[1:] != kind[:-1])
    if len(change):
        return at + int(change[-1]) + 1
    while end < hi:
        other = np.flatnonzero(_KIND[data[end : min(hi, end + CHUNK)]] != kind[0])
        if len(other):
            return end + int(other[0])
        end = min(hi, end + CHUNK)
    return hi


def index_vectors(seed: int = 7) -> np.ndarray:
    """The sparse random index vector (entries -1, 0, 1) of each bucket."""
    rng = np.random.default_rng(seed)
    n = BUCKETS + SHAPES
    out = np.zeros((n, DIM), np.int64)
    for _ in range(NONZERO):
        out[np.arange(n), rng.integers(0, DIM, n)] = rng.choice([-1, 1], n)
    return out


def context_sums(data: np.ndarray, offsets: np.ndarray, index: np.ndarray, total: np.ndarray) -> None:
    """Add to ``total``, for each bucket, the index vectors around its tokens (integers, so any order of adding agrees)."""
    last = np.zeros(0, np.int32)
    for a, b, bucket, at, goes_on in token_chunks(data, offsets):
        old = last if goes_on else last[:0]
        line = np.concatenate([old, bucket])
        row = np.concatenate([np.zeros(len(old), np.int64), rows_of(at)])
        for step in range(REACH + 1):
            later = np.arange(max(step, len(old)), len(line))
            later = later[row[later] == row[later - step]]
            pair, count = np.unique(line[later - step].astype(np.int64) * len(index) + line[later], return_counts=True)
            for x, y in ((pair // len(index), pair % len(index)), (pair % len(index), pair // len(index)))[: 1 + (step > 0)]:
                np.add.at(total, x, index[y] * count[:, None])
        last = line[-REACH:]


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    constant: float | None = None

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The document vectors of all rows; an empty text has zeros."""
        out, n = np.zeros((len(offsets) - 1, DIM + 1)), np.zeros(len(offsets) - 1, np.int64)
        for a, b, bucket, at, _ in token_chunks(data, offsets):
            count = np.diff(at)
            has = np.flatnonzero(count)
            if len(has):
                out[a + has, :DIM] += np.add.reduceat(self.vectors[bucket], at[:-1][has], axis=0, dtype=np.float64)
                n[a:b] += count
        out[:, :DIM] /= np.maximum(n, 1)[:, None]
        out[:, DIM] = np.log1p(n)
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(offsets) - 1, self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(self.pooled(data, offsets)) / self.temperature, -60, 60)))


def _train(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, seed: int = 11, steps: int = 400) -> Model:
    """Adam on the whole sample; a fifth of the rows sets the temperature."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / scale
    rng = np.random.default_rng(seed)
    held = rng.permutation(len(y)) < len(y) // 5
    fit = ~held if held.any() and len(set(y[~held])) == 2 else np.ones(len(y), bool)
    w = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    zf, yf = z[fit], y[fit]
    for t in range(1, steps + 1):
        hidden = np.tanh(zf @ w[0] + w[1])
        p = 1 / (1 + np.exp(-np.clip(hidden @ w[2] + w[3][0], -60, 60)))
        g = (p - yf) / len(yf)
        gh = g[:, None] * w[2] * (1 - hidden**2)
        grads = [zf.T @ gh + 1e-4 * w[0], gh.sum(0), hidden.T @ g + 1e-4 * w[2], np.array([g.sum()])]
        for k, gk in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * gk
            v[k] = 0.999 * v[k] + 0.001 * gk**2
            w[k] = w[k] - 0.02 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    model = Model(vectors, mean, scale, w[0], w[1], w[2], float(w[3][0]), 1.0)
    rest = held if held.any() else fit
    logit, target = model.logits(x[rest]), y[rest]
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 121))
    loss = [np.mean(np.logaddexp(0, logit / t) - target * logit / t) for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    return model


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample_rows`` labelled rows (doc_id, quality) whose crc32(doc_id) mod 4 is not 2.

    The sample is the rows with the smallest seeded hash. Rows without a quality
    of 0 or 1 and without a document don't count; of several labels of one document the
    smallest counts, of several texts of one document that with the smallest hash. Null texts count as
    empty; long ones are read whole, in chunks. The rows of the sample are fetched once and written to the
    checkpoint folder. Extra columns don't matter. With no rows, or one class only, every score is the
    share of label 1 (0.5 with no rows).
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where("doc_id is not null and quality in (0, 1)").where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(sample_rows)
    if sample_rows <= BROADCAST_ROWS:
        known = F.broadcast(known)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(known, "doc_id")
    rows = settle(rows.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text")))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, seen = index_vectors(), False
        total = np.zeros_like(index)
        for batch in batches:
            context_sums(*text_bytes(batch.column(0)), index, total)
            seen = True
        release()
        if seen:
            used = np.flatnonzero(total.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(total[used, d]) for d in range(DIM))], names=["bucket", *(f"v{d}" for d in range(DIM))])

    names = [f"v{d}" for d in range(DIM)]
    sums = rows.select("text").mapInArrow(partial, "bucket long, " + ", ".join(f"{c} long" for c in names))
    table = sums.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in names)).toPandas()
    raw = index_vectors().astype(np.float64)
    if len(table):
        raw[table["bucket"].to_numpy()] += table[names].to_numpy(np.float64)
    vectors = (raw / np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    blank = Model(vectors, np.zeros(DIM + 1), np.ones(DIM + 1), np.zeros((DIM + 1, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0, 1.0)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = blank.pooled(*text_bytes(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])
        release()

    got: pd.DataFrame = rows.select("doc_id", "quality", "text").mapInArrow(pooled, "doc_id long, quality int, x array<double>").toPandas()
    if got["quality"].nunique() < 2:
        blank.constant = float(got["quality"].mean()) if len(got) else 0.5
        return blank
    x, y = np.stack(got["x"].to_numpy()), got["quality"].to_numpy(np.float64)
    order = np.lexsort((x[:, -1], x[:, 0], got["doc_id"].to_numpy()))
    return _train(x[order], y[order], vectors)


def quality_scores(spark: SparkSession, docs: DataFrame, model: Model, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """``keep`` (columns of ``docs``; doc_id if not given) and a score, called ``name``, from each whole text; null texts count as empty.

    A narrow map: no shuffle, one row for each input row; equal texts score alike, wherever they stand. Long
    texts take the memory of one chunk beside their own bytes. An empty table gives no rows. ``keep`` must not hold ``name``.
    """
    shared = spark.sparkContext.broadcast(model)
    keep = keep or ["doc_id"]
    columns = [F.col(f"`{c}`") for c in keep]
    source = docs.select(*columns) if "text" in keep else docs.select(*columns, F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score(*text_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(score)], names=[*keep, name])
        release()

    return source.mapInArrow(run, T.StructType([*source.schema.fields[: len(keep)], T.StructField(name, T.DoubleType())]))


def quality_query(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from a score of ``THRESHOLD``) of every row.

    Null and empty texts have the score of a document without tokens; a null doc_id isn't held out; repeated rows
    give repeated results; extra columns are dropped; without labels every score is 0.5; no documents, no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = quality_scores(spark, docs, fit(docs, labels))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
