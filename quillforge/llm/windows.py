"""Substring dedup over word windows with a count-min prefilter.

Pass one: every shard adds its windows to ``ROWS`` count-min rows; a shard's sketch is
kept as its non-zero cells and the shards' sketches are merged block by block (a
count of two or more is all that is asked of them). Pass two: only windows whose smallest
count is two or more (an overestimate, so none is lost) are grouped by what they are: by 96-bit
keys made of two independent hashes of the bytes of their words (the words themselves don't travel; two
different windows share both with a chance of 2 ** -96, which is below 1e-10 for all pairs of 10^9 windows), and each shard learns which of its windows a smaller shard holds. Pass three cuts
the covered words. All three read the same exchange of the documents.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillforge.llm import exchange as ex
from quillforge.llm.columns import BLANKS, U64, byte_table, mix, rows_of, span_hash, window_hash, words

WINDOW = 20
ROWS = 2
#: Cells of a count-min row for each window, at least.
CELLS = 4
BLOCK_KEYS = 1_000_000


class Plan:
    """Sizes of the sketch that follow from the bytes of the corpus."""

    def __init__(self, total_bytes: int, window: int):
        self.window = window
        most = max(1024, total_bytes // 2)  # a word and its blank take two bytes at least
        self.bits = math.ceil(math.log2(CELLS * most / 2.5))
        blocks = max(0, math.ceil(math.log2(max(1, most / 2.5 / BLOCK_KEYS))))
        self.shift = self.bits - blocks
        self.wide_shift = 64 - blocks

    def cells(self, h: np.ndarray, row: int) -> np.ndarray:
        return mix(h, seed=row + 1) >> U64(64 - self.bits)


class Windows:
    """Words and windows of a shard."""

    def __init__(self, shard: ex.Shard, k: int):
        self.data = shard.data
        self.starts, self.ends, self.h, self.offsets = words(shard.data, shard.offsets)
        left = np.repeat(self.offsets[1:], np.diff(self.offsets)) - np.arange(len(self.h))
        self.at = np.flatnonzero(left >= k)
        self.hash = window_hash(self.h, k)[self.at] if len(self.at) else np.zeros(0, U64)

    def second(self, which: np.ndarray, k: int) -> np.ndarray:
        """32 more bits of the chosen windows, from another hash of the bytes of their words."""
        inside = np.zeros(len(self.h) + 1, np.int64)
        np.add.at(inside, self.at[which], 1)
        np.add.at(inside, self.at[which] + k, -1)
        used = np.flatnonzero(np.cumsum(inside[:-1]))
        h, out = np.zeros(len(self.h), U64), np.zeros(len(which), U64)
        h[used] = span_hash(self.data, self.starts[used], self.ends[used], byte_table(blanks=BLANKS), seed=99)
        for j in range(k):
            out = out * U64(0x8CB92BA72F3D8DD7) + h[self.at[which] + j]
        return (mix(out) >> U64(32)).astype(np.uint32)


def _repeated(w: Windows, plan: Plan, got: list[dict[int, bytes]]) -> np.ndarray:
    """Windows whose count-min estimate is two or more."""
    out = np.ones(len(w.hash), bool)
    for row in range(ROWS):
        cells, inverse, count = np.unique(plan.cells(w.hash, row), return_inverse=True, return_counts=True)
        out &= ((count > 1) | ex.marked(cells, plan.shift, got[row]))[inverse]
    return np.flatnonzero(out)


def _distinct(w: Windows, chosen: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct 96-bit keys (sorted), the class of each chosen window, and which chosen windows come first in their class."""
    hi, lo = w.hash[chosen], w.second(chosen, k)
    by = np.lexsort((lo, hi))  # stable, so windows of a class stay in order
    new = np.ones(len(by), bool)
    new[1:] = (hi[by][1:] != hi[by][:-1]) | (lo[by][1:] != lo[by][:-1])
    kind = np.empty(len(by), np.int64)
    kind[by] = np.cumsum(new) - 1
    first = np.zeros(len(by), bool)
    first[by[new]] = True
    return hi[by][new], lo[by][new], kind, first


def cut_repeats(docs: DataFrame, window: int = WINDOW, shard_bytes: int = ex.SHARD_BYTES) -> DataFrame:
    """Each document without the words that a repeated window covers: doc_id, n_words, n_removed, kept, removed.

    A window is ``window`` consecutive words (parted by ASCII blanks) of one document. It is repeated if
    the same words start earlier: in a smaller doc_id, or earlier in the same document. ``kept`` is the
    other words joined by one space, ``removed`` the word ranges [start, end) cut. Rows
    with equal ids are taken in the order of a hash of their text, null ids come
    first, null texts have no words. Extra columns are dropped. One row for each input row; an empty table gives none.
    """
    dealt = ex.deal(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), shard_bytes)
    plan, rows = Plan(dealt.bytes, window), dealt.rows

    def sketch(key: tuple, table: pa.Table) -> pa.Table:
        w, out = Windows(ex.in_order(table), window), []
        for row in range(ROWS):
            out += ex.cell_messages(key[0].as_py(), row, np.unique(plan.cells(w.hash, row)), plan.shift)
        return ex.message_table(out)

    def exact(key: tuple, table: pa.Table, got: pa.Table) -> pa.Table:
        if not len(table):
            return ex.message_table([])
        w = Windows(ex.in_order(table), window)
        hi, lo, _, _ = _distinct(w, _repeated(w, plan, [ex.answers(got, r) for r in range(ROWS)]), window)
        return ex.message_table([(key[0].as_py(), ROWS, block, b - a, ex.wide_keys(hi[a:b], lo[a:b])) for block, a, b in ex.by_block(hi, plan.wide_shift)])

    def cut(table: pa.Table, got: pa.Table) -> pa.Table:
        if not len(table):
            return RESULT.empty_table()
        shard = ex.in_order(table)
        w = Windows(shard, window)
        chosen = _repeated(w, plan, [ex.answers(got, r) for r in range(ROWS)])
        hi, _, kind, first = _distinct(w, chosen, window)
        earlier = ex.marked(hi, plan.wide_shift, ex.answers(got, ROWS))
        gone = w.at[chosen[~first | earlier[kind]]]
        step = np.zeros(len(w.h) + 1, np.int64)
        np.add.at(step, gone, 1)
        np.add.at(step, gone + window, -1)
        return _result(shard, w, np.cumsum(step[:-1]) > 0)

    counted = rows.groupBy("__shard").applyInArrow(sketch, ex.MESSAGE)
    seen = counted.groupBy("part", "block").applyInArrow(ex.merge_cells, ex.ANSWER)
    asked = rows.groupBy("__shard").cogroup(seen.groupBy("shard")).applyInArrow(exact, ex.MESSAGE)
    earlier = asked.groupBy("part", "block").applyInArrow(ex.merge_wide_earlier, ex.ANSWER)
    return rows.groupBy("__shard").cogroup(seen.unionByName(earlier).groupBy("shard")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, kept string, removed array<array<long>>")


RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("removed", pa.list_(pa.list_(pa.int64())))])


def _result(shard: ex.Shard, w: Windows, gone: np.ndarray) -> pa.Table:
    n_words = np.diff(w.offsets)
    total = np.append(0, np.cumsum(gone))
    n_removed = total[w.offsets[1:]] - total[w.offsets[:-1]]
    keep = np.flatnonzero(~gone)
    lengths = w.ends[keep] - w.starts[keep] + 1
    flat = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(w.starts[keep], lengths)
    out = np.append(shard.data, np.uint8(32))[flat]
    ends = np.cumsum(lengths)
    out[ends - 1] = 32
    bounds = np.append(0, ends)[np.searchsorted(keep, w.offsets)]
    raw = out.tobytes()
    kept = [raw[a : max(a, b - 1)].decode() for a, b in zip(bounds, bounds[1:], strict=False)]
    row = rows_of(w.offsets)
    edge = gone.copy()
    edge[1:] &= ~gone[:-1] | (row[1:] != row[:-1])
    stop = gone.copy()
    stop[:-1] &= ~gone[1:] | (row[1:] != row[:-1])
    a, b = np.flatnonzero(edge), np.flatnonzero(stop) + 1
    cuts = np.searchsorted(a, w.offsets)
    removed = [[[int(a[k] - o), int(b[k] - o)] for k in range(lo, hi)] for o, lo, hi in zip(w.offsets, cuts, cuts[1:], strict=False)]
    return pa.table([shard.table.column("doc_id").cast(pa.int64()), pa.array(n_words), pa.array(n_removed), pa.array(kept, pa.string()), pa.array(removed, RESULT.field("removed").type)], schema=RESULT)


def windows_query(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words.

    Null and empty texts have no words and keep none; of rows that share a doc_id those with smaller text hashes come first, rows
    without one before all; repeated rows lose their windows to the first of them; extra columns are dropped; an empty table gives no rows.
    """
    return cut_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
