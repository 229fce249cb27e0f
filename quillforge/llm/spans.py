"""Exact substring dedup over bytes with suffix arrays.

A string of ``LENGTH`` bytes is a window. The position of the smallest hash of
``GRAM`` bytes inside a window (the leftmost on ties) is its anchor: equal windows have equal
anchors at equal places, so all that can repeat meets under the anchor's key. Every run
of windows with one anchor is a context, and every window lies in exactly one context.

1. Shards send the anchors they have, as cells, with the number of different contexts of each; owners of
   cell ranges answer which another shard has too, and which have very many contexts.
2. Shards send the bytes of their different contexts of shared anchors to the shard of the suffix space that owns the
   anchor. It builds a suffix array (Larsson-Sadakane), takes common prefixes (Kasai) and reports
   the windows that share ``LENGTH`` bytes. Contexts are compared as bytes; no digest decides.
3. Shards cover the bytes of all repeated windows.

An anchor with more than ``HOT`` different contexts (a very common passage under ever other text) would be one large array; its
windows are compared by 96-bit keys instead, which spread evenly. ``hot`` sets the bound; a large one leaves all to arrays.
Keys are mixed before they are routed, for the smallest of many hashes is a small number. Every answer
is found by binary search in the sorted runs that the shards sent.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillforge.llm import exchange as ex
from quillforge.llm.columns import U64, byte_table, mix, powers, release
from quillforge.llm.suffix import common_prefixes, suffix_array

LENGTH = 200
GRAM = 100
SHARD_BYTES = 1_000_000
OWNER_BYTES = 500_000
#: Different contexts of one anchor above which its windows are compared by key.
HOT = 1500
ANCHOR, BYTES, KEYS = 0, 1, 2
BASES = (0xD1342543DE82EF95, 0x9FB21C651E98DF25)
_EMPTY = np.zeros(0, np.int64)


@lru_cache(8)
def _powers(base: int, n: int) -> np.ndarray:
    return powers(base, n)


class Rolling:
    """64-bit hashes of any byte span in constant time: prefix sums of byte * base ** place."""

    def __init__(self, data: np.ndarray, base: int):
        n = len(data)
        step = 1 << max(16, n.bit_length())  # powers are kept for a few lengths
        self.sums = np.zeros(n + 1, U64)
        value = byte_table()[data]
        value *= _powers(base, step)[:n]
        np.cumsum(value, out=self.sums[1:])
        self.back = _powers(pow(base, -1, 1 << 64), step)

    def spans(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sums[b] - self.sums[a]) * self.back[a]

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - 1
        out = self.sums[k:] - self.sums[: n + 1 - k]
        out *= self.back[: n + 1 - k]
        return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of x[i : i + width] for each i (shorter at the end)."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        np.minimum(out[: len(out) - step], out[step:], out=out[: len(out) - step])
        have += step
    return out


class Contexts:
    """Contexts of a shard: arrays key (of the anchor), first and last (window starts)."""

    def __init__(self, shard: ex.Shard, length: int, gram: int):
        self.length, data, offsets = length, shard.data, shard.offsets
        self.key = np.zeros(0, U64)
        self.first = self.last = _EMPTY
        long = np.diff(offsets) >= length
        if not long.any():
            return
        self.roll = Rolling(data, BASES[0])
        n, width = len(data), length - gram + 1
        grams = self.roll.grams(gram)
        h = np.full(n, np.iinfo(np.uint32).max, np.uint32)  # orders the places; equal numbers of unequal grams do no harm
        h[: n - gram + 1] = ((grams ^ (grams >> U64(29))) * U64(0x94D049BB133111EB)) >> U64(32)
        least = sliding_min(h, width)
        # runs of windows, within a document, whose least number is one
        whole = np.zeros(n + 1, np.int32)
        np.add.at(whole, offsets[:-1][long], 1)
        np.add.at(whole, offsets[1:][long] - length + 1, -1)
        inside = np.cumsum(whole[:-1]) > 0
        edge = inside.copy()
        edge[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
        edge[offsets[:-1][long]] = True
        first = np.flatnonzero(edge)
        stop = np.append(first[1:], n)
        ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1 if not inside[-1] or n > 1 else np.array([n])
        ends = np.append(ends, n) if inside[-1] else ends
        last = np.minimum(stop, ends[np.searchsorted(ends, first, side="right")]) - 1
        # the leftmost place with that number: the one that has just come in, else one to look for
        anchor = first + width - 1
        look = np.flatnonzero((h[anchor] != least[first]) | (first == 0) | (least[np.maximum(first - 1, 0)] <= least[first]) | ~inside[np.maximum(first - 1, 0)])
        for a in range(0, len(look), 4096):
            some = look[a : a + 4096]
            window = h[first[some][:, None] + np.arange(width)]
            anchor[some] = first[some] + (window == least[first[some]][:, None]).argmax(1)
        # where the number stands again before the run ends, windows past the first place belong to the next
        again = np.flatnonzero(last > anchor)
        if len(again):
            more: list[list[np.ndarray]] = [[], [], []]
            for r in again.tolist():
                i, j, value = int(first[r]), int(last[r]), least[first[r]]
                places = i + np.flatnonzero(h[i : j + width] == value)
                at = places[np.searchsorted(places, np.arange(i, j + 1))]
                cut = np.append(0, np.flatnonzero(at[1:] != at[:-1]) + 1)
                for column, values in zip(more, (i + cut, np.append(i + cut[1:], j + 1) - 1, at[cut]), strict=True):
                    column.append(values)
            keep = np.ones(len(first), bool)
            keep[again] = False
            first, last, anchor = (np.concatenate([x[keep], *m]) for x, m in zip((first, last, anchor), more, strict=True))
            order = np.argsort(first, kind="stable")
            first, last, anchor = first[order], last[order], anchor[order]
        self.first, self.last, self.key = first, last, mix(grams[anchor], seed=9)

    def kinds(self, which: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Contexts ``which`` told apart by their bytes: the kind of each, and an example of each kind, kinds in order of first appearance."""
        raw, seen = data.tobytes(), {}
        spans = zip(self.first[which].tolist(), (self.last[which] + self.length).tolist(), strict=True)
        kind = np.fromiter((seen.setdefault(raw[a:b], len(seen)) for a, b in spans), np.int64, len(which))
        example = np.empty(len(seen), np.int64)
        example[kind[::-1]] = which[::-1]
        return kind, example


class Sizes:
    def __init__(self, total_bytes: int, length: int, gram: int):
        anchors = max(1024, total_bytes * 2 // (length - gram + 2))
        self.bits = min(63, math.ceil(math.log2(anchors)) + 18)
        blocks = max(0, math.ceil(math.log2(max(1, anchors / 500_000))))
        self.cell_shift = self.bits - blocks
        self.owner_shift = 64 - max(0, math.ceil(math.log2(max(1, total_bytes / 8_000_000))))
        self.wide_shift = 64 - blocks

    def cells(self, key: np.ndarray) -> np.ndarray:
        return key >> U64(64 - self.bits)


def anchor_messages(shard: ex.Shard, number: int, sizes: Sizes, c: Contexts) -> list[tuple]:
    """The shard's cells, each with the number of different contexts in it (65535 stands for more)."""
    cells, inverse, count = np.unique(sizes.cells(c.key), return_inverse=True, return_counts=True)
    different = count.copy()
    several = np.flatnonzero((count > 1)[inverse]) if len(cells) else _EMPTY
    if len(several):
        _, example = c.kinds(several, shard.data)
        different[count > 1] = np.bincount(inverse[example], minlength=len(cells))[count > 1]
    crowd = np.minimum(different, 65535).astype("<u2")
    base = U64((1 << sizes.cell_shift) - 1)
    return [(number, ANCHOR, block, b - a, crowd[a:b].tobytes() + ex.encode_cells(cells[a:b] & base, 1 << sizes.cell_shift)) for block, a, b in ex.by_block(cells, sizes.cell_shift)]


def merge_anchors(table: pa.Table, hot: int = HOT) -> pa.Table:
    """For each shard's run of a block: which of its cells another shard has too, and which hold more than ``hot`` contexts in all."""
    shards, counts, raws = table.column("shard").to_pylist(), table.column("n").to_pylist(), table.column("keys").to_pylist()
    part, block = table.column("part")[0].as_py(), table.column("block")[0].as_py()
    cells = np.concatenate([ex.decode_cells(r[2 * n :]) for r, n in zip(raws, counts, strict=True)])
    crowd = np.concatenate([np.frombuffer(r, "<u2", n) for r, n in zip(raws, counts, strict=True)])
    every, inverse, times = np.unique(cells, return_inverse=True, return_counts=True)
    shared = (times > 1)[inverse]
    crowded = (np.bincount(inverse, weights=crowd, minlength=len(every)) > hot)[inverse]
    out, at = [], 0
    for shard, n in zip(shards, counts, strict=True):
        flags = np.concatenate([shared[at : at + n], crowded[at : at + n]])
        at += n
        if flags.any():
            out.append((shard, part, block, ex.pack_bits(flags)))
    return ex.answer_table(out)


class Known:
    """What a shard knows after the anchors' answers: its contexts of shared anchors, told apart by bytes, kinds in order of their key."""

    def __init__(self, shard: ex.Shard, sizes: Sizes, length: int, gram: int, got: pa.Table):
        c = self.contexts = Contexts(shard, length, gram)
        cells, inverse, count = np.unique(sizes.cells(c.key), return_inverse=True, return_counts=True)
        shared, hot = count > 1, np.zeros(len(cells), bool)
        bits = ex.answers(got, ANCHOR)
        for block, a, b in ex.by_block(cells, sizes.cell_shift):
            if block in bits:
                flags = ex.unpack_bits(bits[block], 2 * (b - a))
                shared[a:b] |= flags[: b - a]
                hot[a:b] = flags[b - a :]
        which = np.flatnonzero(shared[inverse]) if len(cells) else _EMPTY
        self.which = which[np.argsort(c.key[which], kind="stable")]
        self.kind, self.example = c.kinds(self.which, shard.data)
        self.key = c.key[self.example]
        self.twice = np.bincount(self.kind, minlength=len(self.example)) > 1
        crowded = hot[inverse[self.example]] if len(cells) else np.zeros(0, bool)
        self.by_bytes, self.by_keys = np.flatnonzero(~crowded), np.flatnonzero(crowded)
        self.counts = c.last[self.example] - c.first[self.example] + 1
        self.offsets = np.append(0, np.cumsum(self.counts))

    def windows(self, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window starts of the examples of ``kinds``, and for each the index into ``kinds``."""
        n = self.counts[kinds]
        owner = np.repeat(np.arange(len(kinds)), n)
        return self.contexts.first[self.example[kinds]][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n), owner

    def window_keys(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct sorted 96-bit keys of the windows of crowded anchors, the class of each window, and which classes are known to repeat here."""
        starts, owner = self.windows(self.by_keys)
        stop = starts + self.contexts.length
        hi = mix(self.contexts.roll.spans(starts, stop), seed=5)
        lo = (mix(Rolling(data, BASES[1]).spans(starts, stop)) >> U64(32)).astype(np.uint32)
        by = np.lexsort((lo, hi))
        new = np.ones(len(by), bool)
        new[1:] = (hi[by][1:] != hi[by][:-1]) | (lo[by][1:] != lo[by][:-1])
        kind = np.empty(len(by), np.int64)
        kind[by] = np.cumsum(new) - 1
        known = np.bincount(kind, minlength=int(new.sum())) > 1
        known[kind[self.twice[self.by_keys][owner]]] = True
        return hi[by][new], lo[by][new], kind, known

    def repeated(self, flags: np.ndarray) -> np.ndarray:
        """Starts of the windows, over all contexts, whose kind's windows are marked in ``flags`` (laid out by ``offsets``)."""
        n = self.counts[self.kind]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        marked = flags[np.repeat(self.offsets[self.kind], n) + inner]
        return (np.repeat(self.contexts.first[self.which], n) + inner)[marked]


def _flat(offsets: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Places of all elements of the rows ``which``, one row after the other."""
    n = offsets[which + 1] - offsets[which]
    return np.repeat(offsets[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def merge_bytes(table: pa.Table, length: int) -> pa.Table:
    """Windows of an owner's contexts that share ``length`` bytes with a window elsewhere: bits for each shard's run.

    A message holds the contexts' lengths, whether each occurs twice in its shard, their anchors' keys and their bytes. Contexts
    of several shards that are equal whole are one. Anchors are independent, so suffix arrays are built over
    about ``OWNER_BYTES`` of whole anchors at a time; an anchor whose contexts all occur twice needs none.
    """
    shards, raws = table.column("shard").to_pylist(), table.column("keys").to_pylist()
    counts = table.column("n").to_pylist()
    seen: dict[bytes, int] = {}
    runs, weights, keys = [], [], []
    for raw, n in zip(raws, counts, strict=True):
        size, twice, key = np.frombuffer(raw, "<u2", n).tolist(), np.frombuffer(raw, "?", n, 2 * n).tolist(), np.frombuffer(raw, "<u8", n, 3 * n).tolist()
        run, at = np.empty(n, np.int64), 11 * n
        for i in range(n):
            k = run[i] = seen.setdefault(raw[at : at + size[i]], len(seen))
            at += size[i]
            if k == len(weights):
                weights.append(0)
                keys.append(key[i])
            weights[k] += 1 + twice[i]
        runs.append(run)
    weight, key = np.array(weights, np.int64), np.array(keys, U64)
    size = np.fromiter(map(len, seen), np.int64, len(seen))
    data, offsets = np.frombuffer(b"".join(seen), np.uint8), np.append(0, np.cumsum(size))
    del seen
    again = np.repeat(weight > 1, size)
    order = np.argsort(key, kind="stable")
    edges = np.append(np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])), len(order))
    open_anchor = (np.diff(edges) > 1) & (np.add.reduceat(weight[order] < 2, edges[:-1]) > 0)
    todo = order[np.repeat(open_anchor, np.diff(edges))]
    first = np.append(np.flatnonzero(np.append(True, key[todo][1:] != key[todo][:-1])), len(todo)) if len(todo) else np.zeros(1, np.int64)
    total = np.append(0, np.cumsum(size[todo]))
    at = 0
    while at < len(first) - 1:
        stop = max(at + 1, int(np.searchsorted(total[first], total[first[at]] + OWNER_BYTES, side="right")) - 1)
        _common_windows(data, offsets, todo[first[at] : first[stop]], weight, length, again)
        at = stop
    starts = np.append(0, np.cumsum(size - length + 1))
    is_window = np.zeros(len(data) + 1, np.int32)
    np.add.at(is_window, offsets[:-1], 1)
    np.add.at(is_window, offsets[1:] - length + 1, -1)
    flags = again[np.cumsum(is_window[:-1]) > 0]
    part, block = table.column("part")[0].as_py(), table.column("block")[0].as_py()
    bits = [flags[_flat(starts, run)] for run in runs]
    return ex.answer_table([(shard, part, block, ex.pack_bits(b)) for shard, b in zip(shards, bits, strict=True) if b.any()])


def _common_windows(data: np.ndarray, offsets: np.ndarray, which: np.ndarray, weight: np.ndarray, length: int, again: np.ndarray) -> None:
    """Set ``again`` at the window starts of the contexts ``which`` that a second place shares."""
    size = np.diff(offsets)[which]
    local = np.append(0, np.cumsum(size))
    source = _flat(offsets, which)
    text = data[source]
    sa = suffix_array(text, local)
    sa = sa[np.repeat(local[1:], size)[sa] - sa >= length]  # shorter suffixes hold no window
    kind = np.cumsum(common_prefixes(text, local, sa, length) < length) - 1  # runs of suffixes that share a window
    total = np.bincount(kind, weights=np.repeat(weight[which], size)[sa])
    again[source[sa[total[kind] > 1]]] = True


def cut_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, hot: int = HOT) -> DataFrame:
    """``docs`` plus n_bytes, n_removed, spans (byte ranges removed, [start, end)) and kept (the other bytes).

    A byte is removed if a string of ``length`` bytes that covers it also starts anywhere
    else, in another document or this one; every copy goes. Strings don't cross documents and are judged on
    the input. Null texts are empty; repeated rows remove each other; extra columns pass through, but
    columns of ``docs`` with the four names above or starting with __ are left out. An empty table gives no rows. ``hot``
    parts the anchors whose contexts are compared in suffix arrays from those compared by 96-bit window keys (see above).
    """
    added = ["n_bytes", "n_removed", "spans", "kept"]
    carried = [f for f in docs.schema.fields if f.name not in added and not f.name.startswith("__")]
    dealt = ex.deal(docs.select(*(F.col(f"`{f.name}`") for f in carried)), shard_bytes)
    rows, sizes = dealt.rows, Sizes(dealt.bytes, length, gram)

    def anchors(key: tuple, table: pa.Table) -> pa.Table:
        shard = ex.in_order(table)
        out = ex.message_table(anchor_messages(shard, key[0].as_py(), sizes, Contexts(shard, length, gram)))
        release()
        return out

    def send(key: tuple, table: pa.Table, got: pa.Table) -> pa.Table:
        if not len(table):
            return ex.message_table([])
        shard, out, number = ex.in_order(table), [], key[0].as_py()
        k = Known(shard, sizes, length, gram, got)
        first, stop, raw = k.contexts.first, k.contexts.last + length, shard.data.tobytes()
        for block, a, b in ex.by_block(k.key[k.by_bytes], sizes.owner_shift):
            kinds = k.by_bytes[a:b]
            e = k.example[kinds]
            body = b"".join(raw[x:y] for x, y in zip(first[e].tolist(), stop[e].tolist(), strict=True))
            out.append((number, BYTES, block, b - a, (stop - first)[e].astype("<u2").tobytes() + k.twice[kinds].tobytes() + k.key[kinds].tobytes() + body))
        if len(k.by_keys):
            hi, lo, *_ = k.window_keys(shard.data)
            out += [(number, KEYS, block, b - a, ex.wide_keys(hi[a:b], lo[a:b])) for block, a, b in ex.by_block(hi, sizes.wide_shift)]
        del k, raw
        release()
        return ex.message_table(out)

    def resolve(table: pa.Table) -> pa.Table:
        out = merge_bytes(table, length) if table.column("part")[0].as_py() == BYTES else ex.merge_wide_any(table)
        release()
        return out

    def cover(table: pa.Table, got: pa.Table) -> pa.Table:
        if not len(table):
            return pa.table({name: pa.array([], kind) for name, kind in zip(names, kinds(table), strict=True)})
        shard = ex.in_order(table)
        k = Known(shard, sizes, length, gram, got)
        flags = np.zeros(int(k.offsets[-1]), bool)
        bits = ex.answers(got, BYTES)
        for block, a, b in ex.by_block(k.key[k.by_bytes], sizes.owner_shift):
            if block in bits:
                at = _flat(k.offsets, k.by_bytes[a:b])
                flags[at] = ex.unpack_bits(bits[block], len(at))
        if len(k.by_keys):
            hi, _, kind, known = k.window_keys(shard.data)
            flags[_flat(k.offsets, k.by_keys)] = (known | ex.marked(hi, sizes.wide_shift, ex.answers(got, KEYS)))[kind]
        at = k.repeated(flags)
        del k
        step = np.zeros(len(shard.data) + 1, np.int32)
        np.add.at(step, at, 1)
        np.add.at(step, at + length, -1)
        out = covered(shard, np.cumsum(step[:-1]) > 0)
        release()
        return out

    names = [f.name for f in carried] + added
    plus = [pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary()]

    def kinds(table: pa.Table) -> list[pa.DataType]:
        return [table.schema.field(f.name).type for f in carried] + plus

    def covered(shard: ex.Shard, gone: np.ndarray) -> pa.Table:
        o = shard.offsets
        total = np.append(0, np.cumsum(gone))
        inner = np.zeros(len(gone) + 1, bool)
        inner[o] = True
        edge, stop = gone.copy(), gone.copy()
        edge[1:] &= ~gone[:-1] | inner[1:-1]
        stop[:-1] &= ~gone[1:] | inner[1:-1]
        a, b = np.flatnonzero(edge), np.flatnonzero(stop) + 1
        cuts = np.searchsorted(a, o)
        spans = [[[int(a[i] - x), int(b[i] - x)] for i in range(lo, hi)] for x, lo, hi in zip(o, cuts, cuts[1:], strict=False)]
        raw, left = shard.data[~gone].tobytes(), o - total[o]
        kept = [raw[x:y] for x, y in zip(left, left[1:], strict=False)]
        more = [pa.array(np.diff(o)), pa.array(total[o[1:]] - total[o[:-1]]), pa.array(spans, plus[2]), pa.array(kept, pa.binary())]
        return pa.table([*(shard.table.column(f.name) for f in carried), *more], names=names)

    result = T.StructType([*carried, T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("kept", T.BinaryType())])
    sent = rows.groupBy("__shard").applyInArrow(anchors, ex.MESSAGE)
    known = sent.groupBy("part", "block").applyInArrow(lambda table: merge_anchors(table, hot), ex.ANSWER)
    asked = rows.groupBy("__shard").cogroup(known.groupBy("shard")).applyInArrow(send, ex.MESSAGE)
    answered = known.unionByName(asked.groupBy("part", "block").applyInArrow(resolve, ex.ANSWER))
    return rows.groupBy("__shard").cogroup(answered.groupBy("shard")).applyInArrow(cover, result)


def spans_query(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the kept bytes.

    Null texts are empty, repeated rows remove each other, extra columns are dropped, an empty table gives no rows.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut_spans(slim).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
