"""Token ids of whole text columns, each distinct piece encoded once.

A text is cut into the tokenizer's own pre-tokens with numpy; distinct pre-tokens are
encoded by the tokenizer's BPE model and remembered in the worker by a 64-bit hash; a hit counts only if the
characters are equal too. Texts that hold
something the fast cut doesn't handle (an apostrophe, characters from U+3000 on, a special token, or a text that
normalization changes) go through the tokenizer itself. Both give the tokenizer's ids.
"""

from __future__ import annotations

import os
import unicodedata
from dataclasses import dataclass

import numpy as np

from quillforge.llm.columns import GOLDEN, U64, mix, slices

#: Entries that a worker remembers before it starts again.
REMEMBER = 1_500_000
TOP = 0x3000
#: The public byte-to-character alphabet of byte-level BPE keeps these ranges as they are.
KEPT_RANGES = ((33, 126), (161, 172), (174, 255))


def _byte_alphabet() -> dict[int, str]:
    kept = {b for a, z in KEPT_RANGES for b in range(a, z + 1)}
    out, extra = {}, 256
    for b in range(256):
        out[b] = chr(b if b in kept else extra)
        extra += b not in kept
    return out


def _classes() -> np.ndarray:
    """1 letter, 2 number, 3 white space, 0 other, for characters below ``TOP``."""
    out = np.zeros(TOP, np.uint8)
    for c in range(TOP):
        kind = unicodedata.category(chr(c))[0]
        out[c] = 1 if kind == "L" else 2 if kind == "N" else 0
    out[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F]] = 3
    return out


@dataclass
class Ids:
    """Token ids of all rows end to end, and n + 1 offsets."""

    ids: np.ndarray
    offsets: np.ndarray


@dataclass
class Encoder:
    path: str

    def __post_init__(self) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(self.path)
        import json

        with open(self.path, encoding="utf-8") as f:
            spec = json.load(f)
        self._forget()
        self.lower = spec["normalizer"] is not None
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.alphabet, self.kind = _byte_alphabet(), _classes()
        # characters that lower-casing or NFC changes in a way that depends on their neighbours, or that grow
        self.odd = np.zeros(TOP, bool)
        self.fold = np.arange(TOP, dtype=np.uint32)
        self.odd[39] = True
        if self.lower:
            for c in range(TOP):
                low = chr(c).lower()
                if len(low) == 1 and ord(low) < TOP:
                    self.fold[c] = ord(low)
                else:
                    self.odd[c] = True
                if unicodedata.combining(chr(c)) or not unicodedata.is_normalized("NFC", chr(c)) or unicodedata.category(chr(c)) == "Cn":
                    self.odd[c] = True
            self.odd[0x3A3] = True
            self.odd[0x1100:0x1200] = True  # conjoining letters compose under NFC
        else:
            self.odd |= np.array([unicodedata.category(chr(c)) == "Cn" for c in range(TOP)])

    def _cuts(self, text: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each pre-token in a run of texts (``begins`` marks where a text starts)."""
        kind = self.kind[text]
        edge = np.ones(len(text), bool)
        if self.lower:
            # single numbers, runs of letters, runs of others; white space is dropped
            edge[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
            edge[begins] = True
            starts = np.flatnonzero(edge)
            ends = np.append(starts[1:], len(text))
            keep = kind[starts] != 3
            return starts[keep], ends[keep]
        # a run is letters, numbers, others or white space; a run takes one space before it
        edge[1:] = kind[1:] != kind[:-1]
        edge[begins] = True
        last_blank = np.zeros(len(text), bool)  # the last of a white run that a run of the same text follows
        last_blank[:-1] = (kind[:-1] == 3) & (kind[1:] != 3)
        inner = np.zeros(len(text) + 1, bool)
        inner[begins] = True
        last_blank &= ~inner[1:]
        edge |= last_blank
        after = np.zeros(len(text), bool)
        after[1:] = last_blank[:-1] & (text[:-1] == 32)
        edge &= ~after
        starts = np.flatnonzero(edge)
        return starts, np.append(starts[1:], len(text))

    def encode(self, texts: list[str]) -> Ids:
        """Ids of each text, without special tokens."""
        parts, counts = [np.zeros(0, np.uint32)], []
        sizes = np.append(0, np.cumsum([len(t) for t in texts]))
        for a, b in slices(sizes, 500_000):
            got = self._encode(texts[a:b])
            parts.append(got.ids)
            counts.append(np.diff(got.offsets))
        return Ids(np.concatenate(parts), np.append(0, np.cumsum(np.concatenate(counts))) if counts else np.zeros(1, np.int64))

    def _encode(self, texts: list[str]) -> Ids:
        lengths = np.array([len(t) for t in texts], np.int64)
        whole = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.append(0, np.cumsum(lengths))
        high = whole >= TOP
        bad = high | self.odd[np.where(high, 0, whole)]
        hit = np.append(0, np.cumsum(bad))
        slow = hit[at[1:]] > hit[at[:-1]]
        for s in self.specials:
            slow |= np.fromiter((s in t or self.lower and s in t.lower() for t in texts), bool, len(texts)) if any(s[:2] in t for t in texts) else False
        fast = np.flatnonzero(~slow)
        out_n = np.zeros(len(texts), np.int64)
        keep = np.repeat(~slow, lengths)
        text, begins = (whole if keep.all() else whole[keep]), np.append(0, np.cumsum(lengths[fast]))
        if self.lower:
            text = self.fold[text]
        starts, ends = self._cuts(text, begins[:-1][begins[:-1] < len(text)]) if len(text) else (np.zeros(0, np.int64),) * 2
        flat, counts = self._lookup(text, starts, ends)
        total = np.append(0, np.cumsum(counts))
        edges = total[np.searchsorted(starts, begins)] if len(starts) else np.zeros(len(begins), np.int64)
        out_n[fast] = np.diff(edges)
        if not slow.any():
            return Ids(flat, np.append(0, np.cumsum(out_n)))
        pieces: list[np.ndarray] = [flat[edges[i] : edges[i + 1]] for i in range(len(fast))]
        answer: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        for i, p in zip(fast, pieces, strict=True):
            answer[i] = p
        left = np.flatnonzero(slow)
        for i, e in zip(left, self.tokenizer.encode_batch_fast([texts[i] for i in left], add_special_tokens=False), strict=True):
            answer[i] = np.array(e.ids, np.uint32)
            out_n[i] = len(answer[i])
        return Ids(np.concatenate(answer), np.append(0, np.cumsum(out_n)))

    def _lookup(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the pre-tokens, and how many each has. What the memory gives is compared character by character."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        size = ends - starts
        off = np.append(0, np.cumsum(size))
        place = np.arange(int(off[-1])) - np.repeat(off[:-1], size)
        flat = text[place + np.repeat(starts, size)].astype(np.uint16)  # the fast cut has seen that all are below TOP
        h = mix(np.add.reduceat(mix(flat.astype(U64) * GOLDEN + place.astype(U64)), off[:-1]) + size.astype(U64) * GOLDEN)
        distinct, first, kind = np.unique(h, return_index=True, return_inverse=True)
        if len(self.hashes) > REMEMBER:
            self._forget()
        at = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == distinct[inside]
        new = np.flatnonzero(~known)
        if len(new):
            self._learn(flat, off, first[new], distinct[new])
            at = np.searchsorted(self.hashes, distinct)
        entry = at[kind]
        other = self.sizes[entry] != size
        other[~other] = np.logical_or.reduceat(flat != self.chars[np.minimum(place + np.repeat(self.places[entry], size), len(self.chars) - 1)], off[:-1])[~other]
        count, base = self.counts[entry], self.begins[entry]
        source = self.flat
        if other.any():  # another pre-token has this one's hash
            odd = np.flatnonzero(other)
            ids = [self._ids(flat[off[i] : off[i + 1]]) for i in odd.tolist()]
            n = np.array([len(x) for x in ids], np.int64)
            count[odd], base[odd] = n, len(source) + np.cumsum(n) - n
            source = np.concatenate([source, np.array(sum(ids, []), np.uint32)])
        where = np.repeat(base - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        return source[where], count

    def _forget(self) -> None:
        self.hashes, self.flat, self.chars = np.zeros(0, U64), np.zeros(0, np.uint32), np.zeros(0, np.uint16)
        self.begins, self.counts, self.places, self.sizes = (np.zeros(0, np.int64) for _ in range(4))

    def _ids(self, chars: np.ndarray) -> list[int]:
        """Token ids of one pre-token by the tokenizer's own model."""
        piece = chars.astype("<u4").tobytes().decode("utf-32-le").encode().decode("latin-1").translate(self.alphabet)
        return [t.id for t in self.tokenizer.model.tokenize(piece)]

    def _learn(self, flat: np.ndarray, off: np.ndarray, which: np.ndarray, hashes: np.ndarray) -> None:
        """Encode new pre-tokens (sorted by hash) and merge them into what is known."""
        found = [self._ids(flat[a:b]) for a, b in zip(off[which].tolist(), off[which + 1].tolist(), strict=True)]
        n, size = np.array([len(x) for x in found], np.int64), off[which + 1] - off[which]
        at = np.searchsorted(self.hashes, hashes)
        begins, places = len(self.flat) + np.cumsum(n) - n, len(self.chars) + np.cumsum(size) - size
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        self.flat = np.concatenate([self.flat, np.fromiter((i for x in found for i in x), np.uint32, int(n.sum()))])
        self.chars = np.concatenate([self.chars, flat[inner + np.repeat(off[which], size)]])
        self.hashes = np.insert(self.hashes, at, hashes)
        for name, value in (("begins", begins), ("counts", n), ("places", places), ("sizes", size)):
            setattr(self, name, np.insert(getattr(self, name), at, value))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary(name: str) -> str:
    """Where the public vocabulary file of that name lies."""
    import public_tokenizers

    return public_tokenizers.path(name)
