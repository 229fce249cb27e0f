"""Corpus operators: lines, preparation, bounded sampling, vocabularies, n-gram models, decontamination."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillforge.functions import text as tx
from quillforge.operators.linked import settled


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, pos and line; a last line without text after a line end doesn't count."""
    body = F.regexp_replace(F.col(text), "\n$", "")
    return docs.where(F.col(text).isNotNull() & (F.col(text) != "")).select("*", F.posexplode(F.split(body, "\n", -1)).alias("pos", "line"))


def first_wins(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each value of the column ``key`` in ``order``: an aggregate that combines on the map side, sorted by a hash of the key before the key itself.

    The key travels once, the other columns beside it.
    """
    others = [c for c in rows.columns if c != key]
    best = rows.groupBy(F.xxhash64(key).alias("__hash"), F.col(key).alias("__key")).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("__row"))
    return best.select(*(F.col("__key").alias(c) if c == key else F.col(f"__row.{c}").alias(c) for c in rows.columns))


def prepare(rows: DataFrame, script: str = tx.LAO, shortest: int = 8, longest: int = 180, least: float = 0.5, limit: int | None = None) -> DataFrame:
    """Normalized eligible lines, each text once (first wins by doc_id and pos); filters run before the dedup."""
    clean = rows.withColumn("line", tx.normalize_line(F.col("line"))).where(tx.eligible(F.col("line"), script, shortest, longest, least))
    unique = first_wins(clean, "line", "doc_id", "pos")
    return unique if limit is None else unique.orderBy("doc_id", "pos").limit(limit)


#: Eligible lines of a range, about, the most ranges, and the ranges that are folded at a time.
RANGE_LINES, RANGES, WAVE = 200_000, 1024, 16


def _digest(line: str) -> bytes:
    return blake2b(line.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def bounded_sample(rows: DataFrame, limit: int, per_document: int, max_documents: int | None = None, range_lines: int = RANGE_LINES, wave: int = WAVE) -> DataFrame:
    """An ordered fold over (doc_id, pos, line): a text counts once, a document gives at most ``per_document``, all give at most ``limit``.

    A document that has reached its cap marks nothing more as seen, so later documents may still give those texts; that makes the fold
    sequential. It is done by speculation: ranges of doc_id of about ``range_lines`` lines are folded apart, ``wave`` at a time, each as if the ranges
    before it in the wave gave none of its texts. In order, a range stands if what it took wasn't taken by them; the first that doesn't stand begins the next
    wave, which knows all that was taken. So the result is that of one fold, a task holds one range, and no range after the one that reaches the
    limit, or the last document allowed, is read but for the rest of its wave. The driver holds 16 bytes for each line taken, at most ``limit``, and for those of a wave.
    Rows without a doc_id or a line don't take part.
    """
    spark, names, rows = rows.sparkSession, rows.columns, rows.where("doc_id is not null and line is not null")
    n, low, knots = rows.agg(F.count("*"), F.min("doc_id"), F.percentile_approx("doc_id", F.array(*(F.lit(k / RANGES) for k in range(1, RANGES))), 10 * RANGES)).first()
    if not n:
        return rows.where("false")
    step = max(1, math.ceil(RANGES * range_lines / n))
    cuts = sorted(set(knots[step - 1 :: step]) - {low})
    edges = [None, *cuts, None]  # range i: edges[i] <= doc_id < edges[i + 1]
    kind = T.StructType([*rows.schema.fields, T.StructField("__range", T.IntegerType()), T.StructField("__nth", T.LongType()), T.StructField("__doc", T.LongType()), T.StructField("__line", T.BinaryType())])
    seen: set[bytes] = set()
    at, taken, documents, parts = 0, 0, 0, []
    while at < len(edges) - 1 and taken < limit and (max_documents is None or documents < max_documents):
        end = min(at + wave, len(edges) - 1)
        mine = rows
        if edges[at] is not None:
            mine = mine.where(F.col("doc_id") >= edges[at])
        if edges[end] is not None:
            mine = mine.where(F.col("doc_id") < edges[end])
        inner = [c for c in edges[at + 1 : end] if c is not None]
        number = F.lit(at) + (F.size(F.filter(F.array(*map(F.lit, inner)), lambda c: c <= F.col("doc_id"))) if inner else F.lit(0))
        known = spark.sparkContext.broadcast(frozenset(seen))

        def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:  # runs before the next wave begins
            pdf = pdf.sort_values(["doc_id", "pos"], kind="stable", ignore_index=True)
            mine: set[bytes] = set()
            current, got, docs, out = None, 0, 0, []
            for i, (doc, line) in enumerate(zip(pdf["doc_id"], pdf["line"], strict=True)):
                if doc != current:
                    current, got, docs = doc, 0, docs + 1
                if got < per_document and len(mine) < limit and (d := _digest(line)) not in mine and d not in known.value:
                    mine.add(d)
                    got += 1
                    out.append((i, len(mine), docs, d))
            # the last document of a range is told even where it gave nothing, for documents are counted too
            kept = pdf.iloc[[i for i, *_ in out]].assign(__nth=[x for _, x, _, _ in out], __doc=[x for _, _, x, _ in out], __line=[x for *_, x in out])
            last = pdf.iloc[[-1]].assign(__nth=0, __doc=docs, __line=None)
            return pd.concat([kept, last], ignore_index=True) if len(kept) else last

        found = settled(mine.withColumn("__range", number.cast("int")).groupBy("__range").applyInPandas(fold, kind))
        marks: dict[int, list] = {}
        for r in found.select("__range", "__nth", "__doc", "__line").collect():
            marks.setdefault(r[0], []).append((r[1], r[2], bytes(r[3]) if r[3] is not None else None))
        known.unpersist()
        wave_taken: set[bytes] = set()
        for i in range(at, end):
            lines = {d for _, _, d in marks.get(i, ()) if d is not None}
            if lines & wave_taken:
                break
            docs = max((doc for _, doc, _ in marks.get(i, ())), default=0)
            most_docs = docs if max_documents is None else min(docs, max_documents - documents)
            keep = sorted(nth for nth, doc, d in marks.get(i, ()) if d is not None and doc <= most_docs)[: limit - taken]
            if keep:
                parts.append(found.where((F.col("__range") == i) & F.col("__nth").between(1, keep[-1])).select(*names))
            wave_taken |= lines
            taken, documents, at = taken + len(keep), documents + docs, i + 1
            if taken >= limit or (max_documents is not None and documents >= max_documents):
                break
        seen |= wave_taken
    return reduce(DataFrame.unionByName, parts) if parts else rows.where("false")


def characters(rows: DataFrame, text: str) -> DataFrame:
    """One row for each character of each text."""
    return rows.select("*", F.explode(F.filter(F.split(F.col(text), ""), lambda c: c != "")).alias("char"))


def vocabulary(rows: DataFrame, text: str) -> DataFrame:
    """Distinct characters but line ends, numbered from 1 in code-point order (0 is the blank)."""
    chars = characters(rows, text).where(~F.col("char").isin("\r", "\n")).select("char").distinct()
    return chars.select("char", F.row_number().over(Window.orderBy("char")).cast("long").alias("id"))


def encoded(texts: DataFrame, key: str, text: str, vocab: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((key, ids), (key, missing)) of normalized texts: the ids of their characters, and for texts with others those characters, sorted.

    A vocabulary (char, id) is bounded by the code points there are, so it is broadcast as one map.
    """
    one = vocab.agg(F.map_from_entries(F.collect_list(F.struct("char", "id"))).alias("__ids"))
    rows = texts.select(key, tx.normalize_text(F.col(text)).alias("t")).join(F.broadcast(one), F.lit(True))
    chars = F.filter(F.split("t", ""), lambda c: c != "")
    rows = rows.select(key, chars.alias("c"), F.transform(chars, lambda c: F.try_element_at("__ids", c)).alias("ids"))
    missing = F.array_sort(F.array_distinct(F.filter(F.transform("c", lambda c, i: F.when(F.get("ids", i).isNull(), c)), lambda c: c.isNotNull())))
    judged = rows.withColumn("missing", missing)
    return judged.where(F.size("missing") == 0).select(key, "ids"), judged.where(F.size("missing") > 0).select(key, "missing")


def decoded(sequences: DataFrame, key: str, vocab: DataFrame) -> DataFrame:
    """(key, text) of label sequences ``ids``: collapsed, then each label's character; null where a label is in no vocabulary."""
    from quillforge.operators.ctc import collapse

    one = vocab.agg(F.map_from_entries(F.collect_list(F.struct("id", "char"))).alias("__chars"))
    rows = sequences.join(F.broadcast(one), F.lit(True)).select(key, F.transform(collapse(F.col("ids")), lambda i: F.try_element_at("__chars", i)).alias("c"))
    return rows.select(key, F.when(~F.exists("c", lambda c: c.isNull()), F.array_join("c", "")).alias("text"))


def vocabulary_checksum(vocab: DataFrame) -> DataFrame:
    """One row: SHA-256 of the vocabulary's JSON form with sorted keys, its characters in order of their ids."""
    chars = F.transform(F.array_sort(F.collect_list(F.struct("id", "char"))), lambda s: s["char"])
    listed = F.array_join(F.transform(chars, lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)), ", ")
    body = F.concat(F.lit('{"blank_id": 0, "characters": ['), listed, F.lit('], "schema_version": "1", "size": '), F.count("*").cast("string"), F.lit("}"))
    return vocab.agg(F.sha2(body, 256).alias("checksum"), F.count("*").alias("size"))


def corpus_vocabulary(texts: DataFrame, text: str) -> DataFrame:
    """``vocabulary`` of the NFC of ``texts``: blocks are reduced to their distinct characters where they are read."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in _blocks(batches):
            found = set().union(*(unicodedata.normalize("NFC", t) for t in block))
            yield pa.RecordBatch.from_arrays([pa.array(["".join(found)])], names=["t"])

    return vocabulary(texts.select(F.lit(0).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(reduce, "t string"), "t")


def missing_characters(rows: DataFrame, text: str, key: str, vocab: DataFrame) -> DataFrame:
    """How many rows hold each character that the vocabulary lacks."""
    chars = characters(rows.select(key, text), text).select(key, "char").distinct()
    return chars.join(F.broadcast(vocab.select("char")), "char", "left_anti").groupBy("char").agg(F.count("*").alias("n_rows"))


def ngram_counts(texts: DataFrame, text: str, order: int) -> DataFrame:
    """Counts of each character after each context of 0 to order - 1 characters; starts are padded with U+0001."""
    padded = F.concat(F.repeat(F.lit("\x01"), order - 1), F.col(text))
    each = texts.where(F.length(text) > 0).select(padded.alias("p"), F.posexplode(F.filter(F.split(F.col(text), ""), lambda c: c != "")).alias("i", "token"))
    sized = each.select("p", "i", "token", F.explode(F.sequence(F.lit(0), F.lit(order - 1))).alias("len"))
    context = F.substring(F.col("p"), F.col("i") + (order - F.col("len")), F.col("len"))
    return sized.groupBy("len", context.alias("context"), "token").agg(F.count("*").alias("n"))


#: Characters counted at once, and the bits that hold one code point.
_BLOCK, _BITS = 1_000_000, 21
#: A model of at most so many trigrams is broadcast.
_BROADCAST = 1_000_000


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For every character of ``texts``: the number of its text, and it with the two before it in one integer (63 bits, exact)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join("\x01\x01" + t for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    ends = np.cumsum(sizes + 2)
    real = np.ones(len(points), bool)
    real[ends - sizes - 1] = real[ends - sizes - 2] = False
    at = np.flatnonzero(real)
    return np.repeat(np.arange(len(texts)), sizes), points[at - 2] << 2 * _BITS | points[at - 1] << _BITS | points[at]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Keys and texts (not null or empty) of about ``_BLOCK`` characters."""
    for batch in batches:
        keys: list = []
        texts: list[str] = []
        size = 0
        for i in range(batch.num_rows):
            if t := batch.column(1)[i].as_py():
                keys.append(batch.column(0)[i].as_py())
                texts.append(t)
                size += len(t)
            if size >= _BLOCK:
                yield keys, texts
                keys, texts, size = [], [], 0
        if texts:
            yield keys, texts


def packed_trigrams(texts: DataFrame, text: str) -> DataFrame:
    """(gram, n): how often each character follows the two before it, in one integer, over whole texts padded with U+0001.

    Blocks are counted where they are read, so only distinct grams are dealt.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in _blocks(batches):
            gram, n = np.unique(_trigrams(block)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n.astype(np.int64))], names=["gram", "n"])

    return texts.select(F.lit(0).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _character(point: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")


def corpus_ngram_counts(texts: DataFrame, text: str, order: int) -> DataFrame:
    """``ngram_counts`` for ``order`` up to 3 over a corpus: every order is summed from the distinct trigrams."""
    if not 1 <= order <= 3:
        raise ValueError("order must be 1 to 3")
    part = lambda k: F.shiftright("gram", k * _BITS).bitwiseAND((1 << _BITS) - 1)
    before = F.array(F.lit(""), _character(part(1)), F.concat(_character(part(2)), _character(part(1))))
    sized = packed_trigrams(texts, text).select("n", _character(part(0)).alias("token"), F.posexplode(F.slice(before, 1, order)).alias("len", "context"))
    return sized.groupBy("len", "context", "token").agg(F.sum("n").alias("n"))


def corpus_scores(texts: DataFrame, text: str, key: str, vocabulary_size: int, alpha: float = 0.1) -> DataFrame:
    """``backoff_scores`` at order 3 of ``texts`` under the model counted from the same ``texts``.

    Every text is in the model, so every context of two characters is known and none backs off. The distinct trigrams of a
    text are joined with the model, each once with its number of occurrences. The model's distinct trigrams stay cached.
    """
    grams = packed_trigrams(texts, text).persist()
    context = F.shiftright("gram", _BITS)
    totals = grams.groupBy(context.alias("c")).agg(F.sum("n").alias("total"))
    log_p = F.log((F.col("n") + alpha) / (F.col("total") + alpha * vocabulary_size))
    model = grams.withColumn("c", context).join(totals, "c").select("gram", log_p.alias("log_p"))
    small = grams.count() <= _BROADCAST

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, block in _blocks(batches):
            owner, gram = _trigrams(block)
            order = np.lexsort((gram, owner))
            owner, gram = owner[order], gram[order]
            first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (gram[1:] != gram[:-1])])
            times = np.diff(np.r_[first, len(gram)])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()).take(pa.array(owner[first])), pa.array(gram[first]), pa.array(times)], names=[key, "gram", "times"])

    rows = texts.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("t"))
    each = rows.mapInArrow(count, f"{key} long, gram long, times long").join(F.broadcast(model) if small else model, "gram")
    return each.groupBy(key).agg(F.sum(F.col("times") * F.col("log_p")).alias("log_prob"), F.sum("times").alias("n_chars"))


def backoff_scores(texts: DataFrame, text: str, key: str, counts: DataFrame, order: int, vocabulary_size: int, alpha: float = 0.1) -> DataFrame:
    """Sum of log probabilities of each text: the longest context ever seen decides, with additive smoothing."""
    padded = F.concat(F.repeat(F.lit("\x01"), order - 1), F.col(text))
    each = texts.where(F.length(text) > 0).select(key, padded.alias("p"), F.posexplode(F.filter(F.split(F.col(text), ""), lambda c: c != "")).alias("i", "token"))
    totals = counts.groupBy("len", "context").agg(F.sum("n").alias("total"))
    for size in range(order):
        each = each.withColumn(f"c{size}", F.substring(F.col("p"), F.col("i") + (order - size), F.lit(size)))
        t = totals.where(F.col("len") == size).select(F.col("context").alias(f"c{size}"), F.col("total").alias(f"t{size}"))
        n = counts.where(F.col("len") == size).select(F.col("context").alias(f"c{size}"), "token", F.col("n").alias(f"n{size}"))
        each = each.join(t, f"c{size}", "left").join(n, [f"c{size}", "token"], "left")
    total = F.coalesce(*(F.col(f"t{s}") for s in range(order - 1, -1, -1)), F.lit(0))
    n = F.lit(0)
    for s in range(order):
        n = F.when(F.col(f"t{s}").isNotNull(), F.coalesce(F.col(f"n{s}"), F.lit(0))).otherwise(n)
    log_p = F.log((n + alpha) / (total + alpha * vocabulary_size))
    return each.groupBy(key).agg(F.sum(log_p).alias("log_prob"), F.count("*").alias("n_chars"))


# --- models of one to six characters ---------------------------------------------------------------------------------------

#: Code points of 21 bits in a key of two integers: three in each. The last character of a gram is the lowest.
_HALF, _LONGEST = 3, 6
_KEY_COLUMNS = "hi long, lo long"


def _grams(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every character of ``texts``: the number of its text, and it with the order - 1 before it as two integers (exact)."""
    pad = order - 1
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join("\x01" * pad + t for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    starts = np.cumsum(sizes + pad) - sizes
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    hi, lo = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for back in range(order):
        half = lo if back < _HALF else hi
        half |= points[at - back] << ((back % _HALF) * _BITS)
    return np.repeat(np.arange(len(texts)), sizes), hi, lo


def _runs(columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Distinct tuples of the columns in order (the first column leads), and how often each occurs."""
    by = np.lexsort(columns[::-1])
    columns = [c[by] for c in columns]
    new = np.ones(len(by), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    first = np.flatnonzero(new)
    return first, [c[first] for c in columns], np.diff(np.append(first, len(by)))


def packed_grams(texts: DataFrame, text: str, order: int) -> DataFrame:
    """(hi, lo, n): the grams of ``order`` characters of all texts (1 to 6; whole texts, padded with U+0001 before them), counted where they are read.

    Null and empty texts have none. Every shorter gram is the end of one of these, so counts of all lengths are sums of them.
    """
    if not 1 <= order <= _LONGEST:
        raise ValueError("order must be 1 to 6")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in _blocks(batches):
            _, (hi, lo), n = _runs(list(_grams(block, order)[1:]))
            yield pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo), pa.array(n.astype(np.int64))], names=["hi", "lo", "n"])

    return texts.select(F.lit(0).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(count, f"{_KEY_COLUMNS}, n long").groupBy("hi", "lo").agg(F.sum("n").alias("n"))


def _ending(length: int) -> tuple[Column, Column]:
    """The key of a gram's last ``length`` characters."""
    low = lambda k: F.lit((1 << (k * _BITS)) - 1).cast("long")
    hi = F.col("hi").bitwiseAND(low(length - _HALF)) if length > _HALF else F.lit(0).cast("long")
    return hi.alias("hi"), F.col("lo").bitwiseAND(low(min(length, _HALF))).alias("lo")


def _context() -> tuple[Column, Column]:
    """The key of a gram without its last character."""
    carried = F.shiftleft(F.col("hi").bitwiseAND((1 << _BITS) - 1), (_HALF - 1) * _BITS)
    return F.shiftright("hi", _BITS).alias("c_hi"), F.shiftright("lo", _BITS).bitwiseOR(carried).alias("c_lo")


def _text_of(length: int) -> Column:
    """The characters of a key of that length."""
    parts = [(F.col("lo") if k < _HALF else F.col("hi"), k % _HALF) for k in range(length - 1, -1, -1)]
    return F.concat(F.lit(""), *(_character(F.shiftright(half, k * _BITS).bitwiseAND((1 << _BITS) - 1)) for half, k in parts))


def model_counts(grams: DataFrame, order: int) -> DataFrame:
    """``ngram_counts`` from ``packed_grams`` of that order: len, context, token and n for contexts of 0 to order - 1 characters."""
    sized = []
    for length in range(order):
        shorter = grams.select(*_ending(length + 1), "n").groupBy("hi", "lo").agg(F.sum("n").alias("n"))
        cut = shorter.select("n", F.col("lo").bitwiseAND((1 << _BITS) - 1).alias("last"), *_context()).withColumnsRenamed({"c_hi": "hi", "c_lo": "lo"})
        sized.append(cut.select(F.lit(length).alias("len"), _text_of(length).alias("context"), _character(F.col("last")).alias("token"), "n"))
    return reduce(DataFrame.unionByName, sized)


def model_scores(texts: DataFrame, text: str, key: str, grams: DataFrame, order: int, vocabulary_size: int, alpha: float = 0.1) -> DataFrame:
    """``backoff_scores`` of ``texts`` under the model of another corpus (its ``packed_grams`` of that order).

    The distinct grams of all texts fall back level by level: those whose context the model knows are settled by a join on its key, the others go on
    with a context shorter by one; one that is known nowhere, as in an empty model, gets 1 / ``vocabulary_size``. Then every text looks up its own grams, each once
    with its number of occurrences. Joins are on keys of two integers, no text or context travels.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, block in _blocks(batches):
            _, (owner, hi, lo), times = _runs(list(_grams(block, order)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()).take(pa.array(owner)), pa.array(hi), pa.array(lo), pa.array(times.astype(np.int64))], names=["key", "hi", "lo", "times"])

    rows = texts.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("t"))
    each = settled(rows.mapInArrow(count, f"key long, {_KEY_COLUMNS}, times long"))
    left = each.select("hi", "lo", F.col("hi").alias("g_hi"), F.col("lo").alias("g_lo")).distinct()
    done = []
    log_p = F.log((F.coalesce("n", F.lit(0)) + alpha) / (F.coalesce("total", F.lit(0)) + alpha * vocabulary_size))
    for length in range(order, 0, -1):
        ends = grams.select(*_ending(length), "n").groupBy("hi", "lo").agg(F.sum("n").alias("n"))
        totals = ends.select("n", *_context()).groupBy("c_hi", "c_lo").agg(F.sum("n").alias("total"))
        here = left.select("g_hi", "g_lo", *_ending(length)).select("*", *_context())
        met = settled(here.join(F.broadcast(totals) if length == 1 else totals, ["c_hi", "c_lo"], "left"))  # the empty context is one row
        done.append(met.where("total is not null").join(ends, ["hi", "lo"], "left").select("g_hi", "g_lo", log_p.alias("log_p")))
        left = met.where("total is null").select("g_hi", "g_lo", "hi", "lo")
    done.append(left.withColumns({"n": F.lit(0), "total": F.lit(0)}).select("g_hi", "g_lo", log_p.alias("log_p")))
    known = reduce(DataFrame.unionByName, done).withColumnsRenamed({"g_hi": "hi", "g_lo": "lo"})
    summed = each.join(known, ["hi", "lo"]).groupBy("key").agg(F.sum(F.col("times") * F.col("log_p")).alias("log_prob"), F.sum("times").alias("n_chars"))
    return summed.withColumnRenamed("key", key)
