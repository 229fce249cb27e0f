import random
import re

import numpy as np

from quillforge.llm import neardup as nd
from quillforge.llm.components import components

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(rows, k):
    out = []
    for doc_id, text in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
        out.append((doc_id, frozenset(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)) if len(ws) >= k else frozenset([tuple(ws)] if ws else [])))
    return out


def brute(rows, k, percent):
    sets = sets_of(rows, k)
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            both = len(a & b)
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def corpus(seed=6):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(3000))
    texts = []
    for size in (4, 8, 12, 30, 80, 200, 500):
        for _ in range(4):
            base = [word() for _ in range(size)]
            texts.append(" ".join(base))
            for _ in range(rng.randrange(1, 6)):
                copy = base.copy()
                for _ in range(rng.randrange(0, max(2, size // 25))):
                    copy[rng.randrange(size)] = word()
                texts.append(" ".join(w.upper() if rng.random() < 0.1 else w for w in copy))
    hub = [word() for _ in range(300)]  # copies close to the hub, further from each other
    for _ in range(40):
        copy = hub.copy()
        for _ in range(7):
            copy[rng.randrange(300)] = word()
        texts.append("\n".join(copy))
    texts.append(" ".join(hub))
    return texts + texts[:9] + ["a", "a b", "A  B", "a b c"]


def test_against_brute_force(make):
    from tests.llm.conftest import rows

    data = rows(corpus())
    random.Random(3).shuffle(data)
    for k, percent in ((3, 85), (5, 80)):
        got = nd.near_duplicates(make(data), k, percent).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute([(r[1], r[2]) for r in data], k, percent)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_awkward_rows(awkward, empty):
    got = nd.near_duplicates(awkward).collect()
    assert len(got) == awkward.count()
    assert all(r["component_id"] == r["doc_id"] for r in got if r["n_shingles"] == 0)
    assert nd.near_duplicates(empty).count() == 0


def test_estimate_follows_jaccard():
    rng = np.random.default_rng(5)
    for shared in (100, 500, 900):
        pool = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
        a, b = np.sort(pool[:1000]), np.sort(pool[1000 - shared : 2000 - shared])
        regs = nd.registers(np.concatenate([a, b]), np.array([0, 1000, 2000]))
        c = nd.collision(np.array([1000]), np.array([1000]))[0]
        estimate = ((regs[0] == regs[1]).mean() - c) / (1 - c)
        assert abs(estimate - shared / (2000 - shared)) < 0.12


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert got == {x: find(x) for x in parent}


def test_words_that_polynomials_modulo_a_power_of_two_confuse(make):
    from tests.llm.conftest import rows
    from tests.llm.test_tokens import thue_morse

    for n in (1024, 4096):
        got = {r["doc_id"]: r for r in nd.near_duplicates(make(rows([thue_morse(n), thue_morse(n, "b", "a"), thue_morse(n).upper()]))).collect()}
        assert [got[i]["component_id"] for i in (1, 2, 3)] == [1, 2, 1] and got[2]["kept"]


def shingles_of(*texts, k=3):
    raw = [t.encode() for t in texts]
    return nd.shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])), k)


def test_equal_hashes_count_only_if_the_words_are_equal():
    one, two = shingles_of("a bb ccc dd e f gg"), shingles_of("A bb ccc DD e f hh")
    assert nd.common(one, two) == 4
    two.sh[:] = one.sh  # as if all shingles had clashed
    two.first[:] = two.first[::-1].copy()
    assert nd.common(one, two) == sum(one.words(i) == two.words(i) for i in range(len(one.sh)))
    both = shingles_of("a b c d", "x y z w", "a b c e")
    want = [both.words(i) for i in range(len(both.sh))]
    for _ in range(2):
        got = nd.numbered(both).tolist()
        assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(len(want)) for j in range(len(want)))
        both.sh[:] = 5
