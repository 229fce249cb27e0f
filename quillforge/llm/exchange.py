"""Telling shards which of their keys other shards hold too, without shipping what the keys stand for.

Documents are dealt to shards by ranges of doc_id, so a smaller shard number
means smaller ids. A shard sends its sorted, distinct keys, cut into blocks of the key
space; whoever owns a block merges the runs of all shards by binary search and
sends back bits. A key costs a shard one entry however often it occurs there, so the most
frequent key costs no more than the number of shards.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillforge.llm.columns import U64, text_bytes

SHARD_BYTES = 4_000_000
#: Quantiles of the ids, shards to a quantile from which each has quantiles of its own, and the bytes that a row counts at least.
KNOTS, FINE, UNIT = 256, 8, 256
#: Stands for a null id: the smallest number.
NO_ID = -(1 << 63)
MESSAGE = "shard long, part int, block long, n long, keys binary"
ANSWER = "shard long, part int, block long, keys binary"


@dataclass
class Dealt:
    rows: DataFrame
    shards: int
    bytes: int


def _longs(values: list[int]) -> Column:
    """An array literal, however many values."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _weighed(docs: DataFrame, *more: Column) -> DataFrame:
    """__key and __size, once for each ``UNIT`` bytes of a row (__unit counts them from 0), so that quantiles of the key count bytes."""
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long")
    slim = docs.select(_key().alias("__key"), size.alias("__size"), *more)
    return slim.withColumn("__unit", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("__size") / UNIT))))


def _key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def _quantiles() -> Column:
    return F.percentile_approx("__key", F.array(*(F.lit(k / KNOTS) for k in range(KNOTS + 1))), 100 * KNOTS)


def _place(key: Column, tie: Column, knots: Column) -> tuple[Column, Column]:
    """Where ``key`` stands among ``knots``, 0 to KNOTS: between two by its value, a key that is several of them by ``tie`` (0 to 1); and whether it is several."""
    below, upto = F.size(F.filter(knots, lambda k: k < key)), F.size(F.filter(knots, lambda k: k <= key))
    left, right = (F.get(knots, F.greatest(F.lit(0), F.least(F.lit(KNOTS), i))).cast("double") for i in (below - 1, below))
    inner = (key.cast("double") - left) / F.greatest(right - left, F.lit(1.0))
    between = F.greatest(below - 1, F.lit(0)) + F.greatest(F.lit(0.0), F.least(F.lit(1.0), inner))
    return F.when(upto > below, below + (upto - below - 1) * tie).otherwise(between), upto > below + 1


def deal(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> Dealt:
    """``docs`` plus __shard, which doesn't decrease with doc_id (null ids come first), and __tie; about ``shard_bytes`` of text each.

    Ids are spread by quantiles that count bytes (a row counts ``UNIT`` at least), so neither gaps and clusters in ids nor long
    texts in a row make uneven shards; a corpus of very many shards has quantiles inside each quantile. Rows that share an id, or
    have none, are ordered by __tie, a hash of the whole row, and spread over several shards where they are many; only rows
    that are equal in every column stay together.
    """
    docs = docs.withColumn("__tie", F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema.fields if not re.search("map<|variant", f.dataType.simpleString()))))
    first = F.col("__unit") == 0
    total, rows, knots = _weighed(docs).agg(F.coalesce(F.sum(F.when(first, F.col("__size"))), F.lit(0)), F.count(F.when(first, 1)), _quantiles()).first()
    shards = max(1, math.ceil((total + UNIT * rows) / shard_bytes))
    if shards == 1 or not knots:
        return Dealt(docs.withColumn("__shard", F.lit(0).cast("long")), 1, total)
    tie = (F.col("__tie").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    place, several = _place(_key(), tie, _longs(knots))
    if shards > FINE * KNOTS:
        part = F.least(F.lit(KNOTS - 1), F.floor(place)).cast("int")
        finer = {r[0]: r[1] for r in _weighed(docs, part.alias("__part")).groupBy("__part").agg(_quantiles()).collect()}  # KNOTS rows at most
        flat = _longs([k for p in range(KNOTS) for k in finer.get(p, [knots[p]] * (KNOTS + 1))])
        inner, _ = _place(_key(), F.when(several, place - part).otherwise(tie), F.slice(flat, part * (KNOTS + 1) + 1, KNOTS + 1))
        place = part + inner / F.lit(float(KNOTS))
    shard = F.least(F.lit(shards - 1), F.floor(place * F.lit(shards / KNOTS)))
    return Dealt(docs.withColumn("__shard", shard.cast("long")), shards, total)


@dataclass
class Shard:
    """The rows of a shard in ascending doc_id; equal ids by the hash that dealt them."""

    table: pa.Table
    data: np.ndarray
    offsets: np.ndarray


def in_order(table: pa.Table) -> Shard:
    ids = pc.fill_null(table.column("doc_id").cast(pa.int64()), np.iinfo(np.int64).min).to_numpy()
    data, offsets = text_bytes(table.column("text"))
    order = np.lexsort((table.column("__tie").to_numpy(), ids))
    if np.array_equal(order, np.arange(len(order))):
        return Shard(table, data, offsets)
    table = table.take(pa.array(order))
    return Shard(table, *text_bytes(table.column("text")))


def pack_bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags.astype(np.uint8)).tobytes()


def unpack_bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def encode_cells(cells: np.ndarray, span: int) -> bytes:
    """Sorted distinct numbers below ``span``: low bits packed, high bits in unary."""
    n = len(cells)
    low = max(0, int(span // max(n, 1)).bit_length() - 1)
    head = np.array([n, low], np.uint32).tobytes()
    high = (cells >> U64(low)).astype(np.int64)
    unary = np.zeros(int(high[-1]) + n + 1 if n else 0, np.uint8)
    unary[high + np.arange(n)] = 1
    bits = ((cells[:, None] >> np.arange(low, dtype=U64)[None, :]) & U64(1)).astype(np.uint8)
    return head + np.packbits(bits).tobytes() + np.packbits(unary).tobytes()


def decode_cells(raw: bytes) -> np.ndarray:
    n, low = (int(x) for x in np.frombuffer(raw[:8], np.uint32))
    cut = 8 + (n * low + 7) // 8
    bits = np.unpackbits(np.frombuffer(raw[8:cut], np.uint8), count=n * low).reshape(n, low)
    cells = np.zeros(n, U64)
    for j in range(low):
        cells |= bits[:, j].astype(U64) << U64(j)
    high = np.flatnonzero(np.unpackbits(np.frombuffer(raw[cut:], np.uint8)))[:n] - np.arange(n)
    return cells | (high.astype(U64) << U64(low))


def by_block(keys: np.ndarray, shift: int) -> list[tuple[int, int, int]]:
    """(block, from, to) of the non-empty blocks of sorted keys; a block is the key without its ``shift`` low bits."""
    if not len(keys):
        return []
    block = keys >> U64(shift) if shift < 64 else np.zeros(len(keys), U64)
    cut = np.append(0, np.flatnonzero(block[1:] != block[:-1]) + 1)
    return [(int(block[a]), int(a), int(b)) for a, b in zip(cut, np.append(cut[1:], len(keys)), strict=True)]


def cell_messages(shard: int, part: int, cells: np.ndarray, shift: int) -> list[tuple]:
    base = (1 << shift) - 1
    return [(shard, part, block, b - a, encode_cells(cells[a:b] & U64(base), 1 << shift)) for block, a, b in by_block(cells, shift)]


def message_table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["shard", "part", "block", "n", "keys"])


def answer_table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["shard", "part", "block", "keys"])


def merge_cells(table: pa.Table) -> pa.Table:
    """For each shard's run of a block: which of its cells another shard counts too."""
    shards, runs = table.column("shard").to_pylist(), [decode_cells(k) for k in table.column("keys").to_pylist()]
    part, block = table.column("part")[0].as_py(), table.column("block")[0].as_py()
    every = np.sort(np.concatenate(runs))
    again = np.unique(every[1:][every[1:] == every[:-1]])
    out = []
    for shard, run in zip(shards, runs, strict=True):
        at = np.searchsorted(again, run)
        hit = (at < len(again)) & (again[np.minimum(at, len(again) - 1)] == run) if len(again) else np.zeros(len(run), bool)
        if hit.any():
            out.append((shard, part, block, pack_bits(hit)))
    return answer_table(out)


def wide_keys(hi: np.ndarray, lo: np.ndarray) -> bytes:
    """96-bit keys, the first halves before the second."""
    return hi.astype("<u8").tobytes() + lo.astype("<u4").tobytes()


def read_wide(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw) // 12
    return np.frombuffer(raw, "<u8", n), np.frombuffer(raw, "<u4", n, 8 * n)


def merge_wide_earlier(table: pa.Table) -> pa.Table:
    """For each shard's run of a block of 96-bit keys: which of them a smaller shard holds."""
    order = np.argsort(table.column("shard").to_numpy(), kind="stable")
    shards = table.column("shard").to_numpy()[order]
    raws = table.column("keys").to_pylist()
    runs = [read_wide(raws[i]) for i in order]
    part, block = table.column("part")[0].as_py(), table.column("block")[0].as_py()
    hi, lo = np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs])
    by = np.lexsort((lo, hi))  # stable: runs come in ascending shard
    same = (hi[by][1:] == hi[by][:-1]) & (lo[by][1:] == lo[by][:-1])
    later = np.zeros(len(hi), bool)
    later[by[1:][same]] = True
    out, at = [], 0
    for shard, (h, _) in zip(shards, runs, strict=True):
        flags = later[at : at + len(h)]
        at += len(h)
        if flags.any():
            out.append((int(shard), part, block, pack_bits(flags)))
    return answer_table(out)


def answers(table: pa.Table, part: int) -> dict[int, bytes]:
    """block -> bits of one part."""
    if not len(table):
        return {}
    mine = table.filter(pc.equal(table.column("part"), part))
    return dict(zip(mine.column("block").to_pylist(), mine.column("keys").to_pylist(), strict=True))


def marked(keys: np.ndarray, shift: int, got: dict[int, bytes]) -> np.ndarray:
    """The bits of ``got`` laid over sorted keys."""
    out = np.zeros(len(keys), bool)
    for block, a, b in by_block(keys, shift):
        if block in got:
            out[a:b] = unpack_bits(got[block], b - a)
    return out


def merge_wide_any(table: pa.Table) -> pa.Table:
    """For each shard's run of a block of 96-bit keys: which of them another shard holds."""
    shards, runs = table.column("shard").to_pylist(), [read_wide(k) for k in table.column("keys").to_pylist()]
    part, block = table.column("part")[0].as_py(), table.column("block")[0].as_py()
    hi, lo = np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs])
    by = np.lexsort((lo, hi))
    same = (hi[by][1:] == hi[by][:-1]) & (lo[by][1:] == lo[by][:-1])
    both = np.zeros(len(hi), bool)
    both[by[1:][same]] = True
    both[by[:-1][same]] = True
    out, at = [], 0
    for shard, (h, _) in zip(shards, runs, strict=True):
        flags = both[at : at + len(h)]
        at += len(h)
        if flags.any():
            out.append((shard, part, block, pack_bits(flags)))
    return answer_table(out)
