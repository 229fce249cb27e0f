"""Suffix arrays in numpy: Larsson-Sadakane refinement and Kasai's common prefixes, over many short texts at once."""

from __future__ import annotations

import numpy as np

from quillforge.llm.columns import U64

HEAD = 7


def suffix_array(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """All suffixes of the texts data[offsets[i]:offsets[i + 1]] in order; a suffix ends with its text.

    Where one suffix is a prefix of another it comes first; equal suffixes come in the order of their
    texts. Suffixes are ordered by seven bytes first; after that only groups that
    are still tied are refined, by the rank that far ahead, which doubles each time.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    end = offsets[1:][text]
    at = np.arange(n)
    padded = np.append(data, np.zeros(HEAD, np.uint8))
    key = np.zeros(n, U64)
    for j in range(HEAD):
        byte = padded[j : j + n].astype(U64)
        byte[at + j >= end] = 0
        key = (key << U64(8)) | byte
    key = (key << U64(8)) | np.minimum(end - at, HEAD).astype(U64)
    sa = np.argsort(key)  # ties may come in any order here; they are parted below
    new = np.ones(n, bool)
    new[1:] = key[sa][1:] != key[sa][:-1]
    del key
    rank = np.empty(n, np.int64)
    start = np.maximum.accumulate(np.where(new, at, 0))
    rank[sa] = start
    step = HEAD
    while True:
        last = np.ones(n, bool)
        last[:-1] = new[1:]
        tied = np.flatnonzero(~(new & last))  # places in sa of groups with two or more
        if not len(tied):
            return sa
        p = sa[tied]
        ahead = p + step
        # past the end of a text its number decides, below any rank
        second = np.where(ahead < end[p], rank[np.minimum(ahead, n - 1)] + len(offsets), text[p])
        both = rank[p] * (n + len(offsets)) + second
        order = np.argsort(both)
        p, both = p[order], both[order]
        sa[tied] = p
        differs = np.ones(len(p), bool)
        differs[1:] = both[1:] != both[:-1]
        new[tied] = differs
        start = np.maximum.accumulate(np.where(differs, tied, 0))
        rank[p] = start
        step *= 2


def common_prefixes(data: np.ndarray, offsets: np.ndarray, sa: np.ndarray, least: int = 0) -> np.ndarray:
    """lcp[i]: bytes that suffixes sa[i - 1] and sa[i] share (0 for i = 0), by Kasai's rule.

    The rule (the next suffix of a text shares at least one byte less than this one) goes
    through one text position after the other; all texts take that step together. ``sa`` may hold only the suffixes of
    ``least`` bytes or more: then the rule starts anew where the neighbour's next suffix is too short to be among them.
    """
    n = len(data)
    if not len(sa):
        return np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    end = offsets[1:][text]
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    shared = np.zeros(n, np.int64)
    eight = np.zeros(n, U64)  # the eight bytes from each place on
    for j in range(8):
        eight[: n - j] |= data[j:].astype(U64) << U64(8 * j)
    starts, lengths = offsets[:-1], np.diff(offsets)
    steps = lengths - max(least, 1) + 1
    alive = np.flatnonzero(steps > 0)
    h = np.zeros(len(offsets) - 1, np.int64)
    for t in range(int(steps.max())):
        alive = alive[steps[alive] > t]
        p = starts[alive] + t
        q = before[p]
        known = np.where(q >= 0, np.maximum(h[alive] - 1, 0), 0)
        if t and least:
            last = before[p - 1]
            known[(last < 0) | (end[last] - last <= least)] = 0
        h[alive] = known
        todo = np.flatnonzero(q >= 0)
        most = np.minimum(end[p] - p, end[q] - q)  # q is -1 where there is none; not used then
        leap = todo
        while len(leap):
            g = h[alive[leap]]
            a = p[leap] + g
            ok = g + 8 <= most[leap]
            ok[ok] = eight[a[ok]] == eight[(q[leap] + g)[ok]]
            leap = leap[ok]
            h[alive[leap]] += 8
        while len(todo):
            a, b = p[todo] + h[alive[todo]], q[todo] + h[alive[todo]]
            ok = (a < end[p[todo]]) & (b < end[q[todo]])
            ok[ok] = data[a[ok]] == data[b[ok]]
            todo = todo[ok]
            h[alive[todo]] += 1
        shared[p] = h[alive]
    return shared[sa]
