"""Numpy views over Arrow text columns, word finding and 64-bit hashing.

Every helper works on whole columns: a string column is one byte buffer plus
offsets, so no Python string is made for a word, window or shingle.
Null texts are read as empty texts.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_MASK = (1 << 64) - 1
#: ASCII blanks that part words: space and \t \n \v \f \r.
BLANKS = b" \t\n\x0b\x0c\r"


def text_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows end to end, and n + 1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # an empty chunked array stays one
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective finisher that spreads every input bit (SplitMix64 constants)."""
    h = h ^ U64(seed & _MASK)
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def byte_table(fold: bool = False, blanks: bytes = b"") -> np.ndarray:
    """A random odd 64-bit value for each byte; blanks are 0; fold: A-Z as a-z."""
    t = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
    if fold:
        t[65:91] = t[97:123]
    t[list(blanks)] = 0
    return t


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


WORD_BASE, SPAN_BASE = 0xD1342543DE82EF95, 0xA0761D6478BD642F
GOLDEN = U64(0x9E3779B97F4A7C15)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (bytes) of each word; blanks part words."""
    is_word = (byte_table(blanks=BLANKS) != 0)[data]
    begin, stop = is_word.copy(), is_word.copy()
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    begin[1:] &= ~is_word[:-1] | cut[1:-1]
    stop[:-1] &= ~is_word[1:] | cut[1:-1]
    return np.flatnonzero(begin), np.flatnonzero(stop) + 1


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words parted by blanks: start, end (bytes), hash, and n + 1 word offsets of the rows."""
    starts, ends = word_spans(data, offsets)
    return starts, ends, span_hash(data, starts, ends, byte_table(fold, BLANKS)), np.searchsorted(starts, offsets)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each of ascending, disjoint, non-empty byte spans; another ``seed`` gives an independent one.

    It is the sum of a random number for each byte and its place, drawn by the finisher from both. Unlike a polynomial
    modulo 2 ** 64, which gives the two Thue-Morse words of 1024 letters one value for any base, it has no
    clashes that follow from a pattern: two given spans share it with a chance of 2 ** -64.
    """
    out = np.zeros(len(starts), U64)
    lengths = ends - starts
    off = np.append(0, np.cumsum(lengths))
    for lo in range(0, int(off[-1]), _HASH_BYTES):  # arrays of bounded size, whatever the length of a span
        hi = min(lo + _HASH_BYTES, int(off[-1]))
        first, last = int(np.searchsorted(off, lo, side="right")) - 1, int(np.searchsorted(off, hi, side="left"))
        edges = np.clip(off[first : last + 1], lo, hi)
        place = np.arange(lo, hi) - np.repeat(off[first:last], np.diff(edges))
        value = table[data[place + np.repeat(starts[first:last], np.diff(edges))]]
        value += place.astype(U64) * GOLDEN
        out[first:last] += np.add.reduceat(mix(value, seed), edges[:-1] - lo)
    return mix(out + lengths.astype(U64) * GOLDEN, seed)


_HASH_BYTES = 1 << 18


def feature_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A polynomial hash of spans modulo 2 ** 64, for feature hashing only: a clash gives two words one vector."""
    if not len(starts):
        return np.zeros(0, U64)
    lengths = ends - starts
    flat = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    value = table[data[flat + np.repeat(starts, lengths)]] * powers(WORD_BASE, int(lengths.max()))[flat]
    total = np.add.reduceat(value, np.cumsum(lengths) - lengths)
    return mix(total + lengths.astype(U64) * GOLDEN)


def window_hash(h: np.ndarray, k: int, base: int = SPAN_BASE) -> np.ndarray:
    """The hash of each k consecutive entries (len(h) - k + 1 of them); ``h`` holds hashes already, and another base gives another one."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, U64)
    for j in range(k):
        out *= U64(base)
        out += h[j : j + n]
    return mix(out)


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """For each element, the row that holds it."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def slices(offsets: np.ndarray, limit: int = 2_000_000) -> list[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes at most (a longer row stands alone), so that arrays stay small."""
    out, a, n = [], 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        out.append((a, min(b, n)))
        a = out[-1][1]
    return out


def release() -> None:
    """Give the memory of freed arrays back to the system: workers are reused, and what one step held would count against the next."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
