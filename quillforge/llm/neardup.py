"""Near duplicates by HyperMinHash.

A document is its set of word shingles. Its sketch has ``REGISTERS`` buckets; each
keeps, of the smallest hash in the bucket, the number of leading zeros and ``MANTISSA`` bits after
them (16 bits in all), and an empty bucket borrows another's by a fixed sequence.

1. Documents with equal sets, by two independent 64-bit hashes of their words, form a class; its smallest doc_id stands for it.
2. Registers are cut into ``BANDS`` bands; classes that share a band meet in a bucket.
   Each bucket offers links to its most central member only (the one in the fullest
   buckets), so a group of copies costs one link for each member and band.
3. Links whose collision-corrected Jaccard estimate falls far below the bar are left out; the others
   are verified on full sets: shingles with equal hashes have their words compared byte by byte. Components are taken from verified links.
4. Where a bucket still holds several components, all its pairs across components are
   estimated, in blocks of bounded size, and verified in the same blocks. So every pair that shares a band is
   either verified, estimated far below the bar, or already in one component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillforge.llm.columns import BLANKS, U64, byte_table, mix, release, rows_of, slices, span_hash, text_bytes, window_hash, words
from quillforge.llm.components import components
from quillforge.llm.stages import settle, tidy

BANDS, ROWS = 40, 6
REGISTERS = BANDS * ROWS
MANTISSA = 10
EMPTY = np.uint16(0xFFFF)
#: Standard deviations that an estimate may lie below the bar before a pair is left out.
MARGIN = 4.5
CHUNK = 1000
#: Pairs of one hub that meet in a part, about.
HUB = 256
SIGNATURE = "doc_id long, n_shingles long, s1 long, s2 long, registers binary"


@dataclass
class Sets:
    """Distinct shingles of rows: hashes, ascending in a row, with the first word of an occurrence of each, n + 1 offsets, and the rows' words."""

    sh: np.ndarray
    first: np.ndarray
    at: np.ndarray
    width: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def second(self) -> np.ndarray:
        """Another hash of each shingle, from the bytes of its words."""
        h, out = span_hash(self.data, self.starts, self.ends, _FOLDED, seed=7), np.zeros(len(self.first), U64)
        for j in range(int(self.width.max(initial=0))):
            out = np.where(j < self.width, out * U64(0x8CB92BA72F3D8DD7) + h[np.minimum(self.first + j, len(h) - 1)], out)
        return mix(out + self.width.astype(U64))

    def words(self, e: int) -> tuple[bytes, ...]:
        """The words of shingle ``e`` as they are."""
        spans = range(int(self.first[e]), int(self.first[e] + self.width[e]))
        return tuple(self.data[self.starts[w] : self.ends[w]].tobytes().lower() for w in spans)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Sets:
    """Distinct shingles of each row; letters A-Z fold to lower case.

    A row with fewer than k words has one shingle, its whole word sequence; a row without words has none.
    """
    starts, ends, h, at = words(data, offsets, fold=True)
    n = np.diff(at)
    left = np.repeat(at[1:], n) - np.arange(len(h))
    whole = np.flatnonzero(left >= k)
    row = rows_of(at)
    sh, owner, first = window_hash(h, k)[whole] if len(whole) else np.zeros(0, U64), row[whole], whole
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        folded = [mix(window_hash(h[at[r] : at[r + 1]], int(n[r])), seed=int(n[r])) for r in short]
        sh, owner, first = np.concatenate([sh, *folded]), np.concatenate([owner, short]), np.concatenate([first, at[short]])
    by = np.lexsort((sh, owner))
    sh, owner, first = sh[by], owner[by], first[by]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (owner[1:] != owner[:-1])
    return Sets(sh[new], first[new], np.searchsorted(owner[new], np.arange(len(offsets))), np.minimum(n, k)[owner[new]], data, starts, ends)


def same_words(one: Sets, e: np.ndarray, two: Sets, f: np.ndarray) -> bool:
    """Whether each shingle ``e`` of ``one`` (no place twice) has the words of shingle ``f`` of ``two``, compared byte by byte."""
    if not np.array_equal(one.width[e], two.width[f]):
        return False
    p, q, width = one.first[e], two.first[f], one.width[e]
    partner = np.full(len(one.starts) + 1, -1, np.int64)
    partner[p] = q
    left, right = [p], [q]
    for t in range(1, int(width.max(initial=1))):  # words that the next shingle of a run compares anyway are left to it
        more = (width > t) & (partner[np.minimum(p + t, len(one.starts))] != q + t)
        left.append(p[more] + t)
        right.append(q[more] + t)
    p, q = np.concatenate(left), np.concatenate(right)
    size = one.ends[p] - one.starts[p]
    if not np.array_equal(size, two.ends[q] - two.starts[q]):
        return False
    for a, b in slices(np.append(0, np.cumsum(size))):
        n = size[a:b]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        if not np.array_equal(_FOLD[one.data[np.repeat(one.starts[p[a:b]], n) + inner]], _FOLD[two.data[np.repeat(two.starts[q[a:b]], n) + inner]]):
            return False
    return True


_FOLDED = byte_table(True, BLANKS)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] = np.arange(97, 123)


def common(one: Sets, two: Sets) -> int:
    """Shingles that the only rows of ``one`` and ``two`` share: found by hash, confirmed word by word."""
    _, e, f = np.intersect1d(one.sh, two.sh, assume_unique=True, return_indices=True)
    if same_words(one, e, two, f):
        return len(e)
    return sum(one.words(i) == two.words(j) for i, j in zip(e.tolist(), f.tolist(), strict=True))


def numbered(sets: Sets) -> np.ndarray:
    """A number for each shingle, equal where the words are equal."""
    _, rep, number = np.unique(sets.sh, return_index=True, return_inverse=True)
    every = np.arange(len(number))
    if same_words(sets, every, sets, rep[number]):
        return number
    seen: dict[tuple[bytes, ...], int] = {}
    return np.fromiter((seen.setdefault(sets.words(i), len(seen)) for i in every.tolist()), np.int64, len(every))


def registers(sh: np.ndarray, at: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (rows, REGISTERS) of sorted shingle sets; rows without shingles stay EMPTY."""
    out = np.full((len(at) - 1, REGISTERS), EMPTY, np.uint16)
    if not len(sh):
        return out
    row = rows_of(at)
    scaled = (sh >> U64(32)) * U64(REGISTERS)
    bucket, rest = (scaled >> U64(32)).astype(np.int64), scaled & U64(0xFFFFFFFF)
    first = np.ones(len(sh), bool)
    first[1:] = (bucket[1:] != bucket[:-1]) | (row[1:] != row[:-1])
    x = rest[first]
    width = np.zeros(len(x), np.int64)  # bit length
    full = x > 0
    width[full] = np.floor(np.log2(x[full].astype(np.float64))).astype(np.int64) + 1
    zeros = 32 - width
    shift = np.maximum(width - 1 - MANTISSA, 0).astype(U64)
    lift = np.maximum(MANTISSA + 1 - width, 0).astype(U64)
    mantissa = ((x >> shift) << lift) & U64((1 << MANTISSA) - 1)
    out[row[first], bucket[first]] = (zeros.astype(U64) << U64(MANTISSA) | mantissa).astype(np.uint16)
    filled = out != EMPTY
    some = np.flatnonzero(filled.any(1) & ~filled.all(1))
    source = out[some]
    r, b = np.nonzero(~filled[some])
    for attempt in range(1, 64 * REGISTERS):
        if not len(r):
            break
        other = (mix((b * 100_003 + attempt).astype(U64), seed=23) % U64(REGISTERS)).astype(np.int64)
        value = source[r, other]
        got = value != EMPTY
        out[some[r[got]], b[got]] = value[got]
        r, b = r[~got], b[~got]
    for i, j in zip(r, b, strict=True):  # no draw hit: the next filled bucket in a circle
        ring = np.roll(source[i], -j)
        out[some[i], j] = ring[ring != EMPTY][0]
    return out


def collision(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Chance that registers of unrelated sets of these sizes are equal (cells of 2 ** -(zeros + 1 + MANTISSA))."""
    la, lb = np.maximum(na / REGISTERS, 1.0), np.maximum(nb / REGISTERS, 1.0)
    s, total = la + lb, 0.0
    for zeros in range(32):
        total = total + la * lb / s * 2.0 ** -(zeros + 1 + MANTISSA) * (np.exp(-s * 2.0 ** -(zeros + 1)) - np.exp(-s * 2.0**-zeros))
    return total


def passes(matches: np.ndarray, na: np.ndarray, nb: np.ndarray, bar: float) -> np.ndarray:
    """Pairs whose sizes allow the bar and whose corrected estimate isn't ``MARGIN`` deviations below it."""
    c = collision(na, nb)
    estimate = (matches / REGISTERS - c) / (1 - c)
    seen = np.minimum(REGISTERS, np.minimum(na, nb)) * 0.6
    low, high = np.minimum(na, nb), np.maximum(na, nb)
    return (low >= bar * high - 1e-9) & (estimate >= bar - MARGIN * np.sqrt(bar * (1 - bar) / np.maximum(seen, 1)))


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, size, 128-bit set hash and registers of each row: one narrow pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in slices(offsets, 500_000):
                sets = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                sh, at = sets.sh, sets.at
                n = np.diff(at)
                sums = [np.zeros(b - a, U64) for _ in range(2)]
                has = n > 0
                if len(sh):
                    for s, h, seed in zip(sums, (sh, sets.second()), (31, 37), strict=True):
                        s[has] = mix(np.add.reduceat(mix(h, seed=seed), at[:-1][has]) + n[has].astype(U64))
                regs = registers(sh, at)
                raw = [r.tobytes() if x else b"" for r, x in zip(regs, n, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array(raw, pa.binary())], names=["doc_id", "n_shingles", "s1", "s2", "registers"])
            release()

    return docs.select("doc_id", "text").mapInArrow(run, SIGNATURE)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.uint16).reshape(-1, REGISTERS)


def band_keys(classes: DataFrame) -> DataFrame:
    """(bucket, band, node): a 64-bit hash of each band's registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = _matrix(batch.column(1)).astype(U64).reshape(batch.num_rows, BANDS, ROWS)
            h = np.zeros((batch.num_rows, BANDS), U64)
            for j in range(ROWS):
                h = h * U64(0x9FB21C651E98DF25) + mix(regs[:, :, j] + U64(j << 20))
            h = mix(h + mix(np.arange(BANDS, dtype=U64) + U64(77))[None, :])
            node = np.repeat(batch.column(0).to_numpy(), BANDS)
            band = np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), pa.array(band), pa.array(node)], names=["bucket", "band", "node"])

    return classes.select("node", "registers").mapInArrow(run, "bucket long, band int, node long")


def _estimated(pairs: DataFrame, classes: DataFrame, bar: float) -> DataFrame:
    """Pairs (a, b, part) that pass the estimate. A hub b meets its pairs in parts, each with a copy of what b holds."""
    one = classes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("registers").alias("ra"))
    two = _parts(pairs, classes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("rb")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                same = (_matrix(batch.column("ra")) == _matrix(batch.column("rb"))).sum(1)
                keep = passes(same, batch.column("na").to_numpy(), batch.column("nb").to_numpy(), bar)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("part")], names=["a", "b", "part"]).filter(pa.array(keep))

    return pairs.join(one, "a").join(two, ["b", "part"]).select("a", "b", "part", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long, part long")


def _parts(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """``held`` (by b) once for each part of b that occurs: as many copies as the hub's pairs fill parts of ``HUB``."""
    return pairs.select("b", "part").distinct().join(held, "b")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, numerator: int) -> DataFrame:
    """Pairs with 100 * intersection >= numerator * union on full sets."""
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    two = _parts(pairs, texts.select(F.col("node").alias("b"), F.col("text").alias("tb")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, y = -1, None
        for batch in batches:
            keep = []
            ids = batch.column("b").to_pylist()
            for i in range(batch.num_rows):
                x = shingle_sets(*text_bytes(batch.column("ta").slice(i, 1)), k)
                if y is None or held != ids[i]:
                    held, y = ids[i], shingle_sets(*text_bytes(batch.column("tb").slice(i, 1)), k)
                both = common(x, y)
                keep.append(both > 0 and 100 * both >= numerator * (len(x.sh) + len(y.sh) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
        release()

    return pairs.join(one, "a").join(two, ["b", "part"]).select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _across(members: DataFrame, label: DataFrame, classes: DataFrame, texts: DataFrame, k: int, numerator: int) -> DataFrame:
    """Verified links (a, b) between different components in one bucket.

    In a bucket, the component with most members is the major one. Its members are dealt to chunks, so are the
    others; a task compares a chunk with a chunk of the others, never two chunks of the major component. A pair
    is looked at in the first band that it shares. A task names its pairs in one row and is then
    given their texts, so what moves grows with the members of a group, not with its pairs.
    """
    known = members.join(label.select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    counts = known.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    shape = counts.groupBy("bucket").agg(F.count("*").alias("parts"), F.max_by("component", F.struct("n", "component")).alias("major"), F.sum("n").alias("all"), F.max("n").alias("most"))
    shape = shape.where("parts > 1 and all > 2").select(  # of two members, the star has tried the only pair
        "bucket", "major", F.ceil(F.col("most") / CHUNK).alias("cm"), F.ceil((F.col("all") - F.col("most")) / CHUNK).alias("co")
    )
    mixed = known.drop("n").join(shape, "bucket").withColumn("is_major", F.col("component") == F.col("major"))
    chunk = F.pmod(F.xxhash64("node"), F.when(F.col("is_major"), F.col("cm")).otherwise(F.col("co")))
    mixed = mixed.withColumn("chunk", chunk.cast("long"))
    # a task is (bucket, x, y): chunk x of the major component (negative numbers) or of the others, against chunk y of the others
    zero, last = F.lit(0).cast("long"), (F.col("co") - 1).cast("long")
    tasks = F.when(
        F.col("is_major"),
        F.transform(F.sequence(zero, last), lambda y: F.struct((-1 - F.col("chunk")).alias("x"), y.alias("y"))),
    ).otherwise(
        F.concat(
            F.transform(F.sequence(zero, (F.col("cm") - 1).cast("long")), lambda x: F.struct((-1 - x).alias("x"), F.col("chunk").alias("y"))),
            F.transform(F.sequence(zero, last), lambda o: F.struct(F.least(o, F.col("chunk")).alias("x"), F.greatest(o, F.col("chunk")).alias("y"))),
        )
    )
    rows = mixed.select("bucket", "band", "node", "component", "chunk", "is_major", F.explode(tasks).alias("task")).select("bucket", "band", "task.x", "task.y", "node", "component", "chunk", "is_major")
    rows = rows.join(classes.select("node", "n", "registers"), "node")
    bar = numerator / 100

    def find(table: pa.Table) -> pa.Table:
        none = pa.table({"bucket": pa.array([], pa.int64()), "x": pa.array([], pa.int64()), "y": pa.array([], pa.int64()), "nodes": pa.array([], pa.list_(pa.int64())), "pairs": pa.array([], pa.binary())})
        if len(table) < 2:
            return none
        regs, n = _matrix(table.column("registers")), table.column("n").to_numpy()
        node, part = table.column("node").to_numpy(), table.column("component").to_numpy()
        x, y, band = table.column("x")[0].as_py(), table.column("y")[0].as_py(), table.column("band")[0].as_py()
        major, chunk = table.column("is_major").to_numpy(), table.column("chunk").to_numpy()
        left = np.flatnonzero(major) if x < 0 else np.flatnonzero(~major & (chunk == x))
        right = np.flatnonzero(~major & (chunk == y))
        found = [np.zeros((0, 2), np.int64)]
        for i in left:
            near = (n[right] >= bar * n[i] - 1e-9) & (n[i] >= bar * n[right] - 1e-9)  # others can't reach the bar
            other = right[near & (part[right] != part[i]) & (node[right] > node[i] if x == y else node[right] != node[i])]
            if not len(other):
                continue
            equal = regs[other] == regs[i]
            keep = passes(equal.sum(1), np.broadcast_to(n[i], other.shape), n[other], bar)
            keep[keep] = ~equal[keep][:, : band * ROWS].reshape(int(keep.sum()), band, ROWS).all(2).any(1)
            found.append(np.stack([np.full(int(keep.sum()), node[i]), node[other[keep]]], 1))
        pairs = np.concatenate(found)
        if not len(pairs):
            return none
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "x": [x], "y": [y], "nodes": pa.array([np.unique(pairs)], pa.list_(pa.int64())), "pairs": pa.array([pairs.tobytes()], pa.binary())})

    def verify(asked: pa.Table, have: pa.Table) -> pa.Table:
        links = [np.zeros((0, 2), np.int64)]
        if len(asked) and len(have):
            pairs = np.frombuffer(asked.column("pairs")[0].as_py(), np.int64).reshape(-1, 2)
            ids = have.column("node").to_numpy()
            order = np.argsort(ids, kind="stable")
            data, offsets = text_bytes(have.column("text"))
            sets = shingle_sets(data, offsets, k)
            at, word = sets.at, numbered(sets)
            mark = np.zeros(len(word) + 1, bool)
            place = order[np.searchsorted(ids[order], pairs)]
            place = place[np.argsort(place[:, 0], kind="stable")]
            cut = np.append(np.flatnonzero(np.append(True, place[1:, 0] != place[:-1, 0])), len(place))
            size = np.diff(at)
            for lo, hi in zip(cut, cut[1:], strict=False):
                i, js = place[lo, 0], place[lo:hi, 1]
                mine = word[at[i] : at[i + 1]]
                mark[mine] = True
                count = size[js]
                flat = np.repeat(at[js] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                both = np.add.reduceat(mark[word[flat]].astype(np.int64), np.cumsum(count) - count)
                mark[mine] = False
                hit = js[100 * both >= numerator * (size[i] + count - both)]
                links.append(np.stack([np.full(len(hit), ids[i]), ids[hit]], 1))
        out = np.concatenate(links)
        release()
        return pa.table({"a": out[:, 0], "b": out[:, 1]})

    asked = settle(rows.groupBy("bucket", "x", "y").applyInArrow(find, "bucket long, x long, y long, nodes array<long>, pairs binary"))
    needed = asked.select(F.col("bucket").alias("b"), F.col("x").alias("i"), F.col("y").alias("j"), F.explode("nodes").alias("node")).join(texts, "node")
    return asked.select("bucket", "x", "y", "pairs").groupBy("bucket", "x", "y").cogroup(needed.groupBy("b", "i", "j")).applyInArrow(verify, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept, one row for each input row.

    Sets are distinct ``shingle``-word sequences of the text, A-Z folded, words parted by ASCII blanks; two
    documents are linked if 100 * intersection >= ``percent`` * union. A text without
    words (or null) has an empty set and is linked with nothing; rows that share a doc_id
    count as one document; a row without an id stays alone: component_id null, kept true. Extra
    columns are dropped. An empty table gives no rows.
    """
    bar, spark = percent / 100, docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = settle(signatures(base, shingle))
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    # rows of one set are many where copies are: they are counted in salted parts, and told their class part by part
    size = signed.count()
    salts = max(1, math.isqrt(size))
    salt = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(salts)).alias("salt")
    some = settle(usable.groupBy("s1", "s2", salt).agg(F.min("doc_id").alias("least")), size)
    groups = some.groupBy("s1", "s2").agg(F.min("least").alias("node"))
    firsts = groups.select(F.col("s1").alias("g1"), F.col("s2").alias("g2"), "node")
    same = (F.col("doc_id") == F.col("node")) & (F.col("s1") == F.col("g1")) & (F.col("s2") == F.col("g2"))
    classes = usable.join(firsts, same, "left_semi").select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "registers")
    classes = settle(classes.dropDuplicates(["node"]))
    tidy(spark)
    buckets = band_keys(classes)
    members = settle(buckets.join(buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "bucket"))
    central = members.groupBy("node").agg(F.sum("n").alias("score"))
    leaders = members.join(central, "node").groupBy("bucket").agg(F.max_by("node", F.struct("score", -F.col("node"))).alias("leader"))
    stars = members.join(leaders, "bucket").where("node <> leader").groupBy(F.col("node").alias("a"), F.col("leader").alias("b")).agg(F.max("n").alias("n"))
    stars = stars.select("a", "b", F.pmod(F.xxhash64("a", F.lit(5)), F.ceil(F.col("n") / HUB)).cast("long").alias("part"))
    met = members.select("node").distinct()
    texts = settle(base.join(met, base.doc_id == met.node, "inner").select("node", "text"))
    twins = _twins(usable, groups)
    likely = settle(_estimated(stars, classes, bar))
    tidy(spark)
    links = settle(_verified(likely, texts, shingle, percent).unionByName(twins))
    tidy(spark)
    label = settle(components(links), links.count())
    tidy(spark)
    more = settle(_across(members, label, classes, texts, shingle, percent))
    tidy(spark)
    if not more.isEmpty():
        label = settle(components(links.unionByName(more)), links.count() + more.count())
    named = groups.join(label, "node", "left").select("s1", "s2", F.coalesce("component", "node").alias("component_id"))
    told = some.select("s1", "s2", "salt").join(named, ["s1", "s2"])
    rows = usable.select("doc_id", "n_shingles", "s1", "s2", salt).join(told, ["s1", "s2", "salt"]).select("doc_id", "n_shingles", "component_id")
    alone = signed.where("not (n_shingles > 0 and doc_id is not null)").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    every = rows.unionByName(alone)
    return every.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _twins(usable: DataFrame, groups: DataFrame) -> DataFrame:
    """Links between the classes of rows that share a doc_id."""
    several = usable.select("doc_id", "s1", "s2").distinct().groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1")
    both = usable.join(several, "doc_id").select("doc_id", "s1", "s2").distinct().join(groups, ["s1", "s2"])
    return both.where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct()
