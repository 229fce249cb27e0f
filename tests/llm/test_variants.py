import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quillforge.llm import variants as va

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_vocabulary(rows):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_variants(words):
    near = {w: [] for w in words}
    for a, b in itertools.combinations(sorted(words), 2):
        if abs(len(a) - len(b)) < 2 and edits(a, b) == 1:
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def collected(frame):
    rows = [tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def some_words(seed, n=260):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abéß") for _ in range(rng.randrange(5, 12))) for _ in range(12)]
    words = {}
    for _ in range(n):
        w = list(rng.choice(stems))
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(w) + 1)
            kind = rng.randrange(3)
            w[i : i + (kind > 0)] = [] if kind == 1 else [rng.choice("abéß÷")]
        words["".join(w)] = rng.choice([3, 3, 4, 6, 12, 24, 50])
    return words


@pytest.mark.parametrize("shard_words, hot", [(20_000, 4_000), (30, 4_000), (40, 5)])
def test_against_all_pairs(spark, shard_words, hot):
    words = some_words(4)
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    got = collected(va.variants(frame, shard_words, hot))
    assert got == plain_variants(words)
    assert sum(r[1] is not None for r in got) > 20 and any(r[2] not in (r[0], r[1]) for r in got)


def test_words_of_two_characters_and_more(spark):
    words = {"".join(w): 3 for n in (2, 3, 4) for w in itertools.product("ab", repeat=n)}
    links = {(r["a"], r["b"]) for r in va.near_words(spark.createDataFrame([*words.items(), (None, 3), ("a", 3)], "word string, n long"), 5, 4).collect()}
    assert links == {(a, b) for a in words for b in words if (len(a), a) < (len(b), b) and edits(a, b) == 1}


def corpus():
    rng = random.Random(8)
    stems = ["".join(rng.choice("abcdeéüÀ") for _ in range(rng.randrange(4, 9))) for _ in range(60)]
    texts = []
    for _ in range(150):
        words = [rng.choice(stems) for _ in range(rng.randrange(60))]
        words = [w.upper() if rng.random() < 0.1 else w[1:] if rng.random() < 0.1 else w for w in words]
        texts.append("".join(w + rng.choice([" ", ", ", "\n", "0", "中", "ā", "'"]) for w in words))
    return texts


def test_whole_query(make, awkward, empty, spark):
    from tests.llm.conftest import rows

    data = rows(corpus()) + rows([None, "", "x" * 300 + " word"] * 3, first=500) + [(None, None, "nameless wordes " * 5, None, None, None, None)]
    pairs = [(r[1], r[2]) for r in data]
    words = plain_vocabulary(pairs)
    got = collected(va.variants_query(make(data)))
    assert got == plain_variants(words) and len(got) > 50
    assert va.variants_query(empty).count() == 0
    assert {r[0] for r in collected(va.variants_query(awkward))} == set(plain_vocabulary([(r["doc_id"], r["text"]) for r in awkward.collect()]))


def test_checksums_and_long_texts():
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcDEé") for _ in range(rng.choice([1, 5, 9, 70, 200]))) for _ in range(4000))
    ids, texts = [7, None, 12345678901], [text, "short words", text[:999]]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw]))
    want = Counter()
    for i, t in zip(ids, texts, strict=True):
        for run in re.findall("[A-Za-zÀ-ÿ]+", t):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    for size in (1 << 20, 1000):
        old, va.CHUNK = va.CHUNK, size
        got = Counter()
        for a, b, lo, hi in va.pieces(data, offsets):
            words, n = va.count_words(ids[a:b], data[lo:hi], np.clip(offsets[a : b + 1], lo, hi) - lo)
            for w, k in zip(words.to_pylist(), n.tolist(), strict=True):
                got[w] += k
        va.CHUNK = old
        assert got == want
