import hashlib
import random

import numpy as np
import pytest

from quillforge.llm.spans import cut_spans, spans_query
from quillforge.llm.suffix import common_prefixes, suffix_array


def test_suffix_array_and_common_prefixes():
    rng = random.Random(3)
    for trial in range(25):
        texts = [bytes(rng.choice(b"ab\x00") for _ in range(rng.randrange(0, 40))) for _ in range(rng.randrange(1, 12))]
        texts += texts[:2] if trial % 3 == 0 else []
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
        sa = suffix_array(data, offsets)
        lcp = common_prefixes(data, offsets, sa)
        want = sorted((t[i:], k, int(offsets[k]) + i) for k, t in enumerate(texts) for i in range(len(t)))
        assert [w[2] for w in want] == sa.tolist()
        for i in range(1, len(want)):
            a, b = want[i - 1][0], want[i][0]
            n = next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b)))
            assert n == lcp[i]
        for least in (2, 5):
            some = sa[[offsets[np.searchsorted(offsets, p, side="right")] - p >= least for p in sa]]
            lcp = common_prefixes(data, offsets, some, least)
            rest = [w for w in want if len(w[0]) >= least]
            for i in range(1, len(rest)):
                a, b = rest[i - 1][0], rest[i][0]
                assert lcp[i] == next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b)))


def test_contexts_against_a_plain_version():
    import pyarrow as pa

    from quillforge.llm import exchange as ex
    from quillforge.llm import spans as sp
    from quillforge.llm.columns import text_bytes

    rng = random.Random(1)
    for _ in range(80):
        texts = []
        for _ in range(rng.randrange(1, 7)):
            n = rng.randrange(0, 90)
            texts.append(rng.choice(["".join(rng.choice("ab") for _ in range(n)), "x" * n, "abc" * (n // 3), "".join(rng.choice("abcdefghij") for _ in range(n))]))
        data, off = text_bytes(pa.array(texts))
        length, gram = rng.choice([(20, 10), (12, 6), (7, 4), (30, 29)])
        c = sp.Contexts(ex.Shard(None, data, off), length, gram)
        starts = [s for a, b in zip(c.first, c.last, strict=True) for s in range(a, b + 1)]
        assert starts == [s for a, b in zip(off, off[1:], strict=False) for s in range(a, b - length + 1)]
        # equal windows lie at equal places of contexts with equal keys, and neighbours of one key and document are one context
        place = {}
        for a, b, k in zip(c.first.tolist(), c.last.tolist(), c.key.tolist(), strict=True):
            for s in range(a, b + 1):
                assert place.setdefault(data[s : s + length].tobytes(), k) == k


def brute(texts, length):
    count, out = {}, []
    raws = [(t or "").encode() for t in texts]
    for b in raws:
        for k in range(len(b) - length + 1):
            count[b[k : k + length]] = count.get(b[k : k + length], 0) + 1
    for b in raws:
        step = np.zeros(len(b) + 1, int)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                step[k] += 1
                step[k + length] -= 1
        gone = np.cumsum(step)[:-1] > 0
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


def corpus(seed=4):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdeé ") for _ in range(rng.randrange(150, 600))) for _ in range(6)]
    texts = []
    for _ in range(60):
        text = ""
        for _ in range(rng.randrange(1, 4)):
            text += "".join(rng.choice("mnopq ") for _ in range(rng.randrange(0, 200)))
            text += rng.choice(passages) if rng.random() < 0.6 else ""
        texts.append(text)
    near = list(texts[0] + passages[0] * 2)
    for _ in range(25):  # one passage with an edit in each copy
        copy = near.copy()
        copy[rng.randrange(len(copy))] = "Z"
        texts.append("".join(copy))
    return texts + texts[:5] + ["ab" * 400, "x" * 1000, None, "", "y" * 199, "z" * 200, "z" * 201]


@pytest.mark.parametrize("shard_bytes,hot", [(1_000_000, 1500), (4_000, 1500), (4_000, 2)])
def test_against_brute_force(make, shard_bytes, hot):
    from tests.llm.conftest import rows

    data = rows(corpus())
    want = {r[1]: w for r, w in zip(data, brute([r[2] for r in data], 200), strict=True)}
    random.Random(5).shuffle(data)
    got = cut_spans(make(data), shard_bytes=shard_bytes, hot=hot)
    assert {"source", "score", "shard", "size", "lang"} <= set(got.columns)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in got.collect()} == want


def test_arrays_decide_where_no_context_is_whole(make, monkeypatch):
    """Two passages that share 260 bytes under different texts on both sides: no context is equal whole, so an array must tell."""
    from quillforge.llm import spans as sp
    from tests.llm.conftest import rows

    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = word(260)
    texts = [word(300) + shared + word(300), word(150) + shared + word(400)]
    got = sorted((r["doc_id"], r["n_removed"]) for r in cut_spans(make(rows(texts))).collect())
    assert got == [(1, 260), (2, 260)]
    calls = []
    monkeypatch.setattr(sp, "suffix_array", lambda *a: calls.append(len(a[0])) or suffix_array(*a))
    from quillforge.llm import exchange as ex

    sizes = sp.Sizes(2000, 200, 100)
    shards = [ex.Shard(None, np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])) for t in texts]
    anchors = [m for i, s in enumerate(shards) for m in sp.anchor_messages(s, i, sizes, sp.Contexts(s, 200, 100))]
    told = sp.merge_anchors(ex.message_table(anchors))
    sent = []
    for i, s in enumerate(shards):
        k = sp.Known(s, sizes, 200, 100, told.filter(np.array(told.column("shard")) == i))
        e = k.example
        body = b"".join(s.data[a : b + 200].tobytes() for a, b in zip(k.contexts.first[e], k.contexts.last[e], strict=True))
        sent.append((i, sp.BYTES, 0, len(e), (k.contexts.last - k.contexts.first + 200)[e].astype("<u2").tobytes() + k.twice.tobytes() + k.key.tobytes() + body))
    assert len(sp.merge_bytes(ex.message_table(sent), 200)) == 2 and calls


def test_awkward_rows(awkward, empty):
    got = spans_query(awkward).collect()
    assert len(got) == awkward.count()
    assert all(r["kept_sha256"] == hashlib.sha256(b"").hexdigest() for r in got if r["n_bytes"] == 0)
    assert spans_query(empty).count() == 0
