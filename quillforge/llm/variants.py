"""Spelling variants: words one insertion, deletion or replacement apart, by Aho-Corasick over halves.

A word of L characters has two segments, its first L // 2 characters and the others. One edit leaves one of them whole, so a word
that is one edit away holds it at its start or its end. Automaton shards hold the segments of every word; every
word is scanned in the shards that hold segments it could contain, and a hit counts if it lies at the right offset, in a word of
the same length or one longer. Hits are verified: exactly one edit.

A shard's segments are chosen by a hash of the segment, so a word goes to four shards at most, however many there are. Where many words
share a segment, its words are dealt to parts and those to be scanned to chunks, and every part meets every chunk in a task of its own.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillforge.llm.columns import release, rows_of, slices, text_bytes
from quillforge.llm.stages import settle

LEAST_LENGTH, LEAST_COUNT = 5, 3
#: One run in so many (by its checksum) loses a character.
DAMAGED = 97
#: Words whose segments a shard holds, and the words of one segment, or scanned for it, that one task holds.
SHARD_WORDS, HOT = 20_000, 4_000
BROADCAST_HOT = 100_000
#: Bytes of text read at a time (inside long documents too), pairs verified at a time, and the length from which a word is handled alone.
CHUNK, PAIRS, LONG = 1 << 20, 1 << 16, 64
LINK = "a string, na long, b string, nb long"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LEAD = 0xC3  # U+00C0 to U+00FF are this byte and one of 80 to BF


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (bytes) and row of each run of letters of whole texts."""
    inside = _LETTER[data] | (data == _LEAD)
    inside[1:] |= data[:-1] == _LEAD
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    stop[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(offsets, starts, side="right") - 1


def pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first row, row after the last, from, to): about ``CHUNK`` bytes; a long row is cut between two runs."""
    for a, b in slices(offsets, CHUNK):
        lo, hi = int(offsets[a]), int(offsets[b])
        while hi - lo > 2 * CHUNK:
            cut = lo + CHUNK
            while cut < hi and (_LETTER[data[cut - 1]] or data[cut - 1] >= 0x80):
                cut += 1
            yield a, b, lo, cut
            lo = cut
        yield a, b, lo, hi


def checksums(prefix: list[bytes], row: np.ndarray, body: np.ndarray, off: np.ndarray, word: np.ndarray) -> np.ndarray:
    """crc32 of prefix[row] + word, for pairs of a row and one of the words that ``off`` cuts ``body`` into."""
    state = np.array([zlib.crc32(p) for p in prefix], np.uint32)[row]
    size = off[word + 1] - off[word]
    out = np.zeros(len(row), np.uint32)
    raw = body.tobytes()
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = zlib.crc32(raw[off[word[i]] : off[word[i] + 1]], int(state[i]))
    short = np.flatnonzero(size <= LONG)
    short = short[np.argsort(-size[short], kind="stable")]
    left, at, register = size[short], off[word[short]], state[short] ^ np.uint32(0xFFFFFFFF)
    for j in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -j, side="left"))  # longer than j
        register[:n] = _CRC[(register[:n] ^ body[at[:n] + j]) & np.uint32(255)] ^ (register[:n] >> np.uint32(8))
    out[short] = register ^ np.uint32(0xFFFFFFFF)
    return out


def count_words(ids: list[int | None], data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Distinct words of a chunk of rows, damaged ones as they come out, and how often each occurs."""
    starts, ends, row = letters(data, offsets)
    size = ends - starts
    off = np.append(0, np.cumsum(size))
    body = _FOLD[data[np.repeat(starts - off[:-1], size) + np.arange(int(off[-1]))]] if len(starts) else data[:0]
    runs = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(off.astype(np.int64)), pa.py_buffer(body.tobytes()))
    coded = runs.dictionary_encode()
    words, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    pair, count = np.unique(row * max(1, len(words)) + code, return_counts=True)
    row, code = pair // max(1, len(words)), pair % max(1, len(words))
    edges = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1) if len(words) else np.zeros(1, np.int64)
    letters_ = np.frombuffer(words.buffers()[2], np.uint8) if len(words) and words.buffers()[2] is not None else np.zeros(0, np.uint8)
    prefix = [b"" if i is None else str(i).encode() for i in ids]
    h = checksums([p + b":" for p in prefix], row, letters_, edges, code)
    hurt = h % np.uint32(DAMAGED) == 0
    whole = np.bincount(code[~hurt], weights=count[~hurt], minlength=len(words)).astype(np.int64)
    changed = []
    for c, x in zip(code[hurt].tolist(), h[hurt].tolist(), strict=True):
        word = words[c].as_py()
        changed.append(word[: x % len(word)] + word[x % len(word) + 1 :])
    there = whole > 0
    out = pa.concat_arrays([words.filter(pa.array(there)), pa.array(changed, pa.large_string())])
    return out, np.concatenate([whole[there], count[hurt]])


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): distinct words of at least ``least_length`` characters that occur ``least_count`` times or more in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, offsets = text_bytes(batch.column(1))
            for a, b, lo, hi in pieces(data, offsets):
                words, n = count_words(ids[a:b], data[lo:hi], np.clip(offsets[a : b + 1], lo, hi) - lo)
                keep = pc.greater_equal(pc.utf8_length(words), least_length)
                yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(n)], names=["word", "n"]).filter(keep)
            release()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = slim.mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def one_edit(a: np.ndarray, b: np.ndarray, la: np.ndarray, longer: np.ndarray, half: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Whether b is a with one character replaced or, where ``longer``, one inserted; rows of characters padded with 0.

    Where ``tail``, the pair was found by a's second segment and counts only if the first one, of ``half`` characters, doesn't stand: else that one has found it.
    """
    place = np.arange(a.shape[1])
    differs = (a != b[:, :-1]) & (place < la[:, None])
    first = np.where(differs.any(1), differs.argmax(1), la)
    shifted = (a != b[:, 1:]) & (place < la[:, None]) & (place >= first[:, None])
    ok = np.where(longer, ~shifted.any(1), differs.sum(1) == 1)
    return ok & (~tail | (first < half))


class Shard:
    """An automaton over the segments of some words; what it finds in other words is verified in blocks."""

    def __init__(self, words: list[str], counts: list[int], heads: list[tuple[str, int]], tails: list[tuple[str, int]]):
        import ahocorasick

        self.words, self.counts = words, counts
        self.automaton = ahocorasick.Automaton()
        held: dict[str, dict[tuple[bool, int], list[int]]] = {}
        for tail, pairs in ((False, heads), (True, tails)):
            for segment, w in pairs:
                held.setdefault(segment, {}).setdefault((tail, len(words[w])), []).append(w)
        for segment, kinds in held.items():
            self.automaton.add_word(segment, (len(segment), {k: np.array(v, np.int64) for k, v in kinds.items()}))
        if held:
            self.automaton.make_automaton()
        self.full = bool(held)

    def scan(self, others: list[str], counts: list[int]) -> Iterator[tuple[str, int, str, int]]:
        """(a, na, b, nb) for each a held here and b scanned, b one edit away, longer than a or, of equal length, greater."""
        if not self.full:
            return
        left, right, tails, size = [], [], [], 0
        for x, word in enumerate(others):
            n = len(word)
            for end, (length, kinds) in self.automaton.iter(word):
                for tail, fits in ((False, end == length - 1), (True, end == n - 1)):
                    for held in (n, n - 1) if fits else ():
                        found = kinds.get((tail, held))
                        if found is not None:
                            left.append(found)
                            right.append(np.full(len(found), x, np.int64))
                            tails.append(np.full(len(found), tail))
                            size += len(found)
            if size >= PAIRS:
                yield from self._verified(np.concatenate(left), np.concatenate(right), np.concatenate(tails), others, counts)
                left, right, tails, size = [], [], [], 0
        if size:
            yield from self._verified(np.concatenate(left), np.concatenate(right), np.concatenate(tails), others, counts)

    def _verified(self, left: np.ndarray, right: np.ndarray, tails: np.ndarray, others: list[str], counts: list[int]) -> Iterator[tuple[str, int, str, int]]:
        for a in range(0, len(left), PAIRS):
            l, r, tail = left[a : a + PAIRS], right[a : a + PAIRS], tails[a : a + PAIRS]
            ws, xs = np.unique(l, return_inverse=True), np.unique(r, return_inverse=True)
            one, la = _characters([self.words[i] for i in ws[0]])
            two, lb = _characters([others[i] for i in xs[0]])
            width = max(one.shape[1], two.shape[1] - 1)
            one, two = _wide(one, width), _wide(two, width + 1)
            step = max(1, (PAIRS * 16) // max(1, width))
            for b in range(0, len(l), step):
                i, j = ws[1][b : b + step], xs[1][b : b + step]
                ok = one_edit(one[i], two[j], la[i], lb[j] > la[i], la[i] // 2, tail[b : b + step])
                for p, q in zip(l[b : b + step][ok].tolist(), r[b : b + step][ok].tolist(), strict=True):
                    w, x = self.words[p], others[q]
                    if len(w) < len(x) or w < x:
                        yield w, self.counts[p], x, counts[q]


def _characters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters (all below U+0100) as rows padded with 0, and lengths."""
    size = np.array([len(w) for w in words], np.int64)
    out = np.zeros((len(words), int(size.max(initial=0))), np.uint8)
    row = np.repeat(np.arange(len(words)), size)
    out[row, np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)] = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    return out, size


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS, hot: int = HOT) -> DataFrame:
    """(a, na, b, nb): every pair of ``words`` (word, n; distinct) one edit apart, once: a is shorter or, of equal length, smaller.

    Characters are those of words here, all below U+0100; words that are null or shorter than two characters have no links. An empty table gives no rows.
    """
    words = words.where(F.length("word") > 1)
    n = F.length("word")
    half = F.floor(n / 2).cast("int")
    # what a shard holds: both segments; where a word must be scanned: where segments it could contain are held
    held = F.array(
        F.struct(F.substring("word", F.lit(1), half).alias("segment"), F.lit(False).alias("tail")),
        F.struct(F.substring("word", half + 1, n).alias("segment"), F.lit(True).alias("tail")),
    )
    patterns = words.select("word", "n", F.inline(held))
    starts = [F.substring("word", F.lit(1), F.floor((n - d) / 2).cast("int")) for d in (0, 1)]
    ends = [F.substring("word", n - k + 1, k) for k in ((n - d) - F.floor((n - d) / 2).cast("int") for d in (0, 1))]
    scanned = words.select("word", "n", F.explode(F.array_distinct(F.filter(F.array(*starts, *ends), lambda s: s != ""))).alias("segment"))
    both = patterns.select("segment", F.lit(1).alias("p"), F.lit(0).alias("x")).unionByName(scanned.select("segment", F.lit(0).alias("p"), F.lit(1).alias("x")))
    crowds = both.groupBy("segment").agg(F.sum("p").alias("p"), F.sum("x").alias("x")).where((F.col("p") > hot) | (F.col("x") > hot))
    crowds = settle(crowds.select(F.col("segment").alias("crowd"), F.ceil(F.col("p") / hot).cast("int").alias("parts"), F.ceil(F.col("x") / hot).cast("int").alias("chunks")))
    many = crowds.count()
    crowds = F.broadcast(crowds) if many <= BROADCAST_HOT else crowds
    spread = lambda rows: rows.join(crowds, F.col("segment") == F.col("crowd"), "left").drop("crowd") if many else rows.select("*", F.lit(None).cast("int").alias("parts"), F.lit(None).cast("int").alias("chunks"))
    one = lambda c: F.greatest(F.lit(1), F.coalesce(c, F.lit(1)))
    every = lambda c: F.explode(F.sequence(F.lit(0), one(c) - 1))
    mine = lambda c, seed: F.pmod(F.xxhash64("word", F.lit(seed)), one(c)).cast("int")
    left = spread(patterns).withColumn("part", mine(F.col("parts"), 7)).withColumn("chunk", every(F.col("chunks")))
    right = spread(scanned).withColumn("chunk", mine(F.col("chunks"), 8)).withColumn("part", every(F.col("parts")))
    shards = max(1, math.ceil(words.count() / shard_words))
    # a segment lies in one shard; a cell of a crowded one, with so many words, is a group of its own
    shard = F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("segment"), F.lit(shards))).otherwise(F.lit(-1)).cast("int")
    cell = F.when(F.col("parts").isNotNull(), F.col("segment")).otherwise(F.lit(""))
    keys = ["shard", "cell", "part", "chunk"]
    left = left.select(shard.alias("shard"), cell.alias("cell"), "part", "chunk", "segment", "tail", "word", "n")
    right = right.select(shard.alias("shard"), cell.alias("cell"), "part", "chunk", F.col("word").alias("other"), F.col("n").alias("m")).distinct()

    def search(patterns: pa.Table, others: pa.Table) -> pa.Table:
        out: list[tuple[str, int, str, int]] = []
        if len(patterns) and len(others):
            patterns = patterns.sort_by([("word", "ascending"), ("tail", "ascending")])
            names, counts = patterns.column("word").to_pylist(), patterns.column("n").to_pylist()
            segments, tails = patterns.column("segment").to_pylist(), patterns.column("tail").to_pylist()
            heads = [(s, i) for i, (s, t) in enumerate(zip(segments, tails, strict=True)) if not t]
            backs = [(s, i) for i, (s, t) in enumerate(zip(segments, tails, strict=True)) if t]
            out = list(Shard(names, counts, heads, backs).scan(others.column("other").to_pylist(), others.column("m").to_pylist()))
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        release()
        return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["a", "na", "b", "nb"])

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, LINK)


def variants(words: DataFrame, shard_words: int = SHARD_WORDS, hot: int = HOT) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word of ``words`` (word, n; distinct).

    A word's form is its near word of largest n, of equal ones the smallest in code-point order, if that n is at least twice the
    word's; else null. The root is where following forms ends, the word itself if it has none. n at least doubles
    with every step, so forms have no cycles and a chain has at most log2(n) steps; steps are doubled, so rounds are log2 of that.
    """
    words = settle(words.select("word", "n"))
    links = settle(near_words(words, shard_words, hot))
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("m")))).alias("e"))
    best = ends.groupBy(F.col("e.word").alias("near")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("e.m")).alias("m"), F.col("e.other").alias("other"))).alias("best"))
    joined = words.join(best, F.col("word") == F.col("near"), "left")
    strong = -F.col("best.m") >= 2 * F.col("n")
    formed = settle(
        joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.other")).alias("form"), F.when(strong, -F.col("best.m")).cast("long").alias("form_n"))
    )
    steps = formed.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        onward = steps.select(F.col("word").alias("at"), F.col("root").alias("next"))
        moved = settle(steps.join(onward, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")))
        steps = moved.select("word", "root")
        if moved.where("went").isEmpty():
            break
    root = steps.select(F.col("word").alias("start"), "root")
    out = formed.join(root, F.col("word") == F.col("start"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants_query(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of all words of 5 characters or more that occur 3 times or more.

    Words are runs of letters (A-Z folded); one run in 97, chosen by a checksum of its doc_id and itself, loses a character. Null and
    empty texts have no words, a null doc_id reads as empty in that checksum, repeated rows count as often as they stand, extra columns are
    dropped, an empty table gives no rows. Ties of counts go by code points.
    """
    return variants(vocabulary(docs))


ORACLE = r"""
WITH RECURSIVE bytes AS (
  SELECT i::BIGINT AS i, i::BIGINT AS v, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM bytes WHERE k < 8
), crc AS (
  SELECT list(v ORDER BY i) AS t FROM bytes WHERE k = 8
), runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), counted AS (
  SELECT doc_id, run, count(*) AS c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs GROUP BY doc_id, run
), summed AS (
  SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(x), 2), lambda p: ('0x' || x[p:p + 1])::BIGINT)), lambda s, b: xor(s // 256, t[(xor(s, b) % 256) + 1])), 4294967295::BIGINT) AS h
  FROM counted, crc
), words AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, c FROM summed
), kept AS (
  SELECT word, sum(c)::BIGINT AS n,
    translate(word, '{letters}', '{others}') AS plain
  FROM words WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3
), cut AS (
  SELECT word, n, plain, unnest(list_prepend(plain, list_transform(range(1, length(plain) + 1), lambda p: left(plain, p - 1) || substr(plain, p + 1)))) AS d FROM kept
), near AS (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.d = b.d AND a.word <> b.word WHERE levenshtein(a.plain, b.plain) = 1
), best AS (
  SELECT word, count(*) AS n_near, min({{'m': -m, 'other': other}}) AS best FROM near GROUP BY word
), formed AS (
  SELECT k.word, k.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best.m >= 2 * k.n THEN best.other END AS form, CASE WHEN -best.m >= 2 * k.n THEN -best.m END::BIGINT AS form_n
  FROM kept k LEFT JOIN best b ON k.word = b.word
), walk AS (
  SELECT word, form AS here, 1 AS step FROM formed WHERE form IS NOT NULL
  UNION ALL SELECT w.word, f.form, step + 1 FROM walk w JOIN formed f ON w.here = f.word WHERE f.form IS NOT NULL
), roots AS (
  SELECT word, arg_max(here, step) AS root FROM walk GROUP BY word
)
SELECT f.word, f.form, coalesce(root, f.word) AS root, f.n, f.n_near, f.form_n FROM formed f LEFT JOIN roots r ON f.word = r.word
"""


def oracle() -> str:
    """DuckDB's levenshtein counts bytes, so the 64 letters that take two are renamed to other ASCII characters."""
    others = "".join(chr(c) for c in range(33, 127) if not chr(c).isalpha() or chr(c).isupper())
    others = others.replace("'", "")[:64]
    return ORACLE.replace("{letters}", "".join(map(chr, range(0xC0, 0x100)))).replace("{others}", others).replace("{{", "{").replace("}}", "}")
