"""Best-fit packing by a grouping genetic algorithm on islands.

Pieces are dealt to groups of bounded size. A group is solved on ``ISLANDS`` islands, each
with a population of packings. A child keeps the well-filled bins of one parent, takes in whole the well-filled bins of the
other that hold none of their pieces, drops the bins that would hold a piece twice, and best-fits the displaced pieces, so such bins
gather from both parents; what counts as full follows from the sums that the lengths allow. After an epoch every island's elite also goes to the next island, and evolution goes on. The best
packing of a group stands; pieces of its loose bins are dealt to new groups and packed once more, so that
the space lost at group borders doesn't grow with the number of groups.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillforge.llm.columns import release, slices
from quillforge.llm.stages import settle
from quillforge.llm.tokenize import encoder, vocabulary

CAPACITY = 1024
END = 2
GROUP = 4096
ISLANDS = 2
POPULATION = 6
CHILDREN = 48
#: Chance that a child keeps a full bin of its first parent, and how much the order of displaced pieces is blurred.
KEPT = 0.98
BLUR = (0.02, 0.1, 0.3, 0.8)
#: A bin counts as well filled from this share of what the lengths allow: such bins are injected, and the others of a group are packed again.
FULL = 0.995
ELITE = "group long, island int, uids binary, lengths binary, bins binary"


def best_fit(lengths: list[int], order: list[int], bin_of: list[int], free: list[int], capacity: int) -> None:
    """Put the pieces of ``order`` each into the fullest open bin that holds it, or a new one.

    ``free`` is the room of each bin (grows with new bins), ``bin_of`` the result; the
    room sizes that occur are bits of one integer, so the fullest bin is found in constant time.
    """
    at_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for b, room in enumerate(free):
        if room > 0:
            at_room[room].append(b)
            mask |= 1 << room
    for i in order:
        n = lengths[i]
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            stack = at_room[room]
            b = stack.pop()
            if not stack:
                mask ^= 1 << room
        else:
            b, room = len(free), capacity
            free.append(room)
        bin_of[i] = b
        room -= n
        free[b] = room
        if room:
            at_room[room].append(b)
            mask |= 1 << room


def fresh(lengths: np.ndarray, rng: np.random.Generator, noise: float, capacity: int) -> np.ndarray:
    """A packing by best fit in descending order of length, blurred by ``noise``."""
    order = np.argsort(-lengths * (1 + noise * rng.random(len(lengths))), kind="stable")
    bins, free = [0] * len(lengths), []
    best_fit(lengths.tolist(), order.tolist(), bins, free, capacity)
    return np.array(bins, np.int64)


def fills(lengths: np.ndarray, bins: np.ndarray) -> np.ndarray:
    return np.bincount(bins, weights=lengths)


def fitness(lengths: np.ndarray, bins: np.ndarray, capacity: int, most: int | None = None) -> tuple[int, int, float]:
    """Smaller is better: bins used, then the number of those filled as far as can be, ``most`` (more is better), then how unevenly they are filled (uneven is better)."""
    fill = fills(lengths, bins)
    return int((fill > 0).sum()), -int((fill == (most or capacity)).sum()), -float(((fill / capacity) ** 2).sum())


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: pieces over half a bin stand alone, and what the longer of them leave free is lost to pieces that don't fit (for each smallest length that counts)."""
    total = np.bincount(lengths, minlength=capacity + 1)
    number, volume = np.append(0, np.cumsum(total)), np.append(0, np.cumsum(total * np.arange(capacity + 1)))  # of lengths below
    n = lambda a, b: number[b] - number[a]
    v = lambda a, b: volume[b] - volume[a]
    k, half = np.arange(0, capacity // 2 + 1), capacity // 2 + 1
    alone, paired = n(capacity - k + 1, capacity + 1), n(half, capacity - k + 1)
    rest = v(k, half) - (paired * capacity - v(half, capacity - k + 1))
    return int((alone + paired + np.maximum(0, -(-rest // capacity))).max())


def best_fill(lengths: np.ndarray, capacity: int) -> int:
    """The largest sum of pieces that a bin can hold."""
    reach, mask = 1, (1 << (capacity + 1)) - 1
    sizes, counts = np.unique(lengths, return_counts=True)
    for size, count in zip(sizes.tolist(), counts.tolist(), strict=True):
        left, step = min(count, capacity // size), 1  # 1, 2, 4, ... copies and the rest
        while left > 0:
            step = min(step, left)
            reach |= (reach << (size * step)) & mask
            left, step = left - step, step * 2
    return reach.bit_length() - 1


def crossover(lengths: np.ndarray, one: np.ndarray, two: np.ndarray, rng: np.random.Generator, capacity: int, full: int | None = None) -> np.ndarray:
    """``one``'s well-filled bins (from ``full`` tokens) with those of ``two`` injected whole where they share no piece; the other pieces are displaced."""
    full = capacity if full is None else full
    mine, other = fills(lengths, one), fills(lengths, two)
    held = (mine >= full) & (rng.random(len(mine)) < KEPT)
    clash = np.zeros(len(other), bool)
    clash[two[held[one]]] = True
    taken = ((other >= full) & ~clash)[two]
    keep = held[one] & ~taken
    # number the bins: injected first, then those kept of ``one``
    out = np.full(len(lengths), -1, np.int64)
    ids, inverse = np.unique(two[taken], return_inverse=True)
    out[taken] = inverse
    kept, inverse = np.unique(one[keep], return_inverse=True)
    out[keep] = inverse + len(ids)
    loose = np.flatnonzero(out < 0)
    loose = loose[np.argsort(-lengths[loose] * (1 + rng.choice(BLUR) * rng.random(len(loose))), kind="stable")]
    bins = out.tolist()
    best_fit(lengths.tolist(), loose.tolist(), bins, np.concatenate([capacity - other[ids], capacity - mine[kept]]).astype(np.int64).tolist(), capacity)
    return np.array(bins, np.int64)


def evolve(lengths: np.ndarray, population: list[np.ndarray], seed: int, capacity: int = CAPACITY, children: int = CHILDREN) -> np.ndarray:
    """The elite after ``children`` crossovers; each child takes the place of the worst if it is better.

    Evolution ends early where the elite needs no more bins than any packing must (``least_bins``).
    """
    rng = np.random.default_rng(seed)
    population, most = list(population), best_fill(lengths, capacity)
    noise = 0.0
    while len(population) < POPULATION:
        population.append(fresh(lengths, rng, noise, capacity))
        noise += 0.05
    scored = sorted(((fitness(lengths, p, capacity, most), k) for k, p in enumerate(population)))
    ranked = [(f, population[k]) for f, k in scored]
    least = least_bins(lengths, capacity)
    for _ in range(children):
        if ranked[0][0][0] <= least:
            break
        i, j = rng.choice(len(ranked), 2, replace=False)
        child = crossover(lengths, ranked[i][1], ranked[j][1], rng, capacity, math.ceil(FULL * most))
        score = fitness(lengths, child, capacity, most)
        if score < ranked[-1][0]:
            ranked[-1] = (score, child)
            ranked.sort(key=lambda x: x[0])
    return ranked[0][1]


def _row(group: int, island: int, uids: np.ndarray, lengths: np.ndarray, bins: np.ndarray) -> pa.Table:
    binary = lambda x: pa.array([x.tobytes()], pa.binary())
    return pa.table([pa.array([group]), pa.array([island], pa.int32()), binary(uids), binary(lengths), binary(bins)], names=["group", "island", "uids", "lengths", "bins"])


def _read(table: pa.Table, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(table.column(c)[i].as_py(), np.int64) for c in ("uids", "lengths", "bins"))


def _solve(items: DataFrame, groups: int, capacity: int, seed: int) -> DataFrame:
    """(uid, group, bin, place, fill) of items (uid, length): one epoch, migration, another epoch, the best of each group."""
    dealt = items.withColumn("group", F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(groups))).withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))

    def first(table: pa.Table) -> pa.Table:
        uids, lengths = table.column("uid").to_numpy(), table.column("length").to_numpy().astype(np.int64)
        by = np.lexsort((uids, -lengths))
        uids, lengths = uids[by], lengths[by]
        group, island = table.column("group")[0].as_py(), table.column("island")[0].as_py()
        return _row(group, island, uids, lengths, evolve(lengths, [], zlib.crc32(f"{seed} {group} {island} 1".encode()), capacity))

    def second(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("from").to_numpy(), kind="stable").tolist()
        uids, lengths, _ = _read(table, order[0])
        group, island = table.column("group")[0].as_py(), table.column("island")[0].as_py()
        elites = [_read(table, i)[2] for i in order]
        return _row(group, island, uids, lengths, evolve(lengths, elites, zlib.crc32(f"{seed} {group} {island} 2".encode()), capacity))

    def best(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("island").to_numpy(), kind="stable").tolist()
        uids, lengths, bins = min((_read(table, i) for i in order), key=lambda x: fitness(x[1], x[2], capacity))
        by = np.lexsort((np.arange(len(bins)), bins))
        uids, lengths, bins = uids[by], lengths[by], bins[by]
        ends = np.cumsum(lengths)
        start = np.ones(len(bins), bool)
        start[1:] = bins[1:] != bins[:-1]
        base = np.maximum.accumulate(np.where(start, ends - lengths, 0))
        fill = fills(lengths, bins).astype(np.int64)[bins]
        return pa.table({"uid": uids, "group": np.full(len(uids), table.column("group")[0].as_py()), "bin": bins, "place": ends - lengths - base, "fill": fill})

    elites = settle(dealt.groupBy("group", "island").applyInArrow(first, ELITE))  # both sides of the union read it
    own = elites.withColumn("from", F.col("island"))
    moved = own.withColumn("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int"))
    again = own.unionByName(moved).groupBy("group", "island").applyInArrow(second, ELITE)
    return again.groupBy("group").applyInArrow(best, "uid long, group long, bin long, place long, fill long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP) -> DataFrame:
    """``pieces`` (a long column length, 1 to ``capacity``) plus sequence_id and offset.

    Sequences have no gap and at most ``capacity`` tokens; sequence ids are any distinct numbers. Columns
    called sequence_id or offset are replaced, others pass through. Repeated rows are pieces
    of their own. An empty table gives no rows. Equal stored inputs give equal results.
    """
    base = settle(pieces.drop("sequence_id", "offset", "__uid").withColumn("__uid", F.monotonically_increasing_id()))
    small = base.where(F.col("length") < capacity).select(F.col("__uid").alias("uid"), F.col("length").cast("long").alias("length"))
    n = small.count()
    solved = settle(_solve(small, max(1, math.ceil(n / group_rows)), capacity, 1))
    good = F.col("fill") >= math.ceil(FULL * capacity)
    number = (F.col("group") * (1 << 26)) + F.col("bin")
    placed = solved.where(good).select("uid", number.alias("sequence_id"), F.col("place").alias("offset"))
    loose = solved.where(~good).select("uid").join(small, "uid")
    m = loose.count()
    if m:
        rest = _solve(loose, max(1, math.ceil(m / group_rows)), capacity, 2)
        placed = placed.unionByName(rest.select("uid", (number + F.lit(1 << 60)).alias("sequence_id"), F.col("place").alias("offset")))
    placed = placed.withColumnRenamed("uid", "__placed")
    joined = base.join(placed, F.col("__uid") == F.col("__placed"), "left").drop("__placed")
    whole = F.col("sequence_id").isNull()
    return joined.withColumn("offset", F.when(whole, 0).otherwise(F.col("offset")).cast("long")).withColumn("sequence_id", F.when(whole, F.col("__uid") + F.lit(1 << 61)).otherwise(F.col("sequence_id"))).drop("__uid")


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, name: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """The token pieces of every whole text (null: empty) with ``end`` after it.

    Documents of more than ``capacity`` tokens are cut into pieces of that length; the first may be
    shorter. Repeated rows give repeated pieces, a null doc_id stays null, extra columns are dropped, an empty table gives no rows.
    ids_crc32 is over little-endian unsigned 32-bit ids; ``with_ids`` adds the ids. One narrow map.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(vocabulary(name))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(np.append(0, np.cumsum([len(t) for t in texts])), 1_000_000):
                got = code.encode(texts[a:b])
                ids = np.insert(got.ids, got.offsets[1:], np.uint32(end)).astype("<u4")
                total = np.diff(got.offsets) + 1
                begin = got.offsets[:-1] + np.arange(b - a)
                count = -(-total // capacity)
                row = np.repeat(np.arange(b - a), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                head = total - (count - 1) * capacity
                start = np.where(piece > 0, head[row] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, head[row])
                view = memoryview(ids.tobytes())
                at = ((begin[row] + start) * 4).tolist()
                stop = ((begin[row] + start + length) * 4).tolist()
                crc = [zlib.crc32(view[x:y]) for x, y in zip(at, stop, strict=True)]
                columns = [batch.column(0).slice(a, b - a).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([ids[x // 4 : y // 4].astype(np.int64) for x, y in zip(at, stop, strict=True)], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
            release()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, PIECES + (", ids array<long>" if with_ids else ""))


def sequences(packed: DataFrame) -> DataFrame:
    """Whole sequences from packed pieces with ids: sequence_id, ids and doc_ids in order of offset."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"))


def packing_query(docs: DataFrame) -> DataFrame:
    """All documents in sequences of at most 1024 tokens: one row for each piece.

    Null and empty texts are one piece, their end mark; repeated rows are packed one by one; extra columns are dropped;
    an empty table gives no rows.
    """
    return pack(pieces(docs, "byte_bpe_50k.json"))
