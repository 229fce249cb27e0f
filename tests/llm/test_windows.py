import hashlib
import random
import re

from quillforge.llm import exchange as ex
from quillforge.llm.windows import cut_repeats, windows_query

import numpy as np


def brute(rows, k):
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(ws)
        for i in range(len(ws) - k + 1):
            t = tuple(ws[i : i + k])
            if t in seen:
                gone[i : i + k] = [True] * k
            seen.add(t)
        out[doc_id] = (len(ws), sum(gone), " ".join(w for w, g in zip(ws, gone, strict=True) if not g))
    return out


def corpus(n=120, seed=2):
    rng = random.Random(seed)
    passages = [[rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(rng.randrange(15, 40))] for _ in range(6)]
    texts = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(1, 4)):
            words += [rng.choice("pqrs") + str(rng.randrange(500)) for _ in range(rng.randrange(0, 30))]
            words += rng.choice(passages) if rng.random() < 0.5 else []
        texts.append(rng.choice([" ", "\n", "\t "]).join(words))
    return texts + texts[:15] + ["same word " * 60]


def test_against_brute_force(make):
    from tests.llm.conftest import rows

    data = rows(corpus())
    random.Random(1).shuffle(data)
    want = brute([(r[1], r[2]) for r in data], 20)
    for shard_bytes in (4_000_000, 2_000):
        got = cut_repeats(make(data), shard_bytes=shard_bytes).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in got} == want
    assert all(sum(b - a for a, b in r["removed"]) == r["n_removed"] for r in got)


def test_awkward_rows(awkward, empty):
    got = windows_query(awkward).collect()
    assert len(got) == awkward.count()
    assert windows_query(empty).count() == 0
    nothing = hashlib.sha256(b"").hexdigest()
    assert all(r["kept_sha256"] == nothing for r in got if r["n_words"] == 0)


def test_cells_round_trip():
    rng = np.random.default_rng(0)
    for span in (8, 1 << 20, 1 << 45):
        cells = np.unique(rng.integers(0, span, 500).astype(np.uint64))
        assert np.array_equal(ex.decode_cells(ex.encode_cells(cells, span)), cells)


def test_words_that_polynomials_modulo_a_power_of_two_confuse(make):
    from tests.llm.conftest import rows
    from tests.llm.test_tokens import thue_morse

    for n in (1024, 4096):
        head = " ".join(f"w{i}" for i in range(19))
        got = windows_query(make(rows([f"{head} {thue_morse(n)}", f"{head} {thue_morse(n, 'b', 'a')}"]))).collect()
        assert [r["n_removed"] for r in got] == [0, 0]


def spread(frame, shard_bytes):
    from pyspark.sql import functions as F

    dealt = ex.deal(frame, shard_bytes)
    got = dealt.rows.groupBy("__shard").agg(F.sum(F.octet_length("text")).alias("n"), F.max(F.octet_length("text")).alias("most"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).orderBy("__shard").collect()
    known = [r for r in got if r["a"] is not None]
    assert all(x["b"] <= y["a"] for x, y in zip(known, known[1:]))
    return dealt, got


def test_shards_hold_even_numbers_of_bytes(spark, make):
    from pyspark.sql import functions as F

    ids = spark.range(20_000).select(F.col("id").alias("doc_id"))
    long_end = ids.select("doc_id", F.when(F.col("doc_id") >= 19_800, F.repeat(F.lit("long text "), 18_000)).otherwise(F.lit("short words here")).alias("text"))
    for frame, size in ((long_end, 1_000_000), (long_end.where("doc_id < 19900"), 4_000_000)):
        dealt, got = spread(frame, size)
        assert len(got) > 3 and max(r["n"] for r in got) <= 2 * size, (dealt.shards, [r["n"] for r in got])
    text = F.concat(F.lit("text "), F.col("doc_id").cast("string"), F.repeat(F.lit(" more"), 40))
    for key in (F.lit(None).cast("long"), F.lit(7).cast("long"), F.when(F.col("doc_id") % 3 > 0, F.col("doc_id"))):
        _, got = spread(ids.select(key.alias("doc_id"), text.alias("text")), 200_000)
        assert len(got) > 10 and max(r["n"] for r in got) <= 800_000
    # so many shards that quantiles have quantiles of their own
    _, got = spread(long_end.where("doc_id % 10 = 0").select(F.col("doc_id") * F.col("doc_id"), "text").toDF("doc_id", "text"), 1_000)
    assert sum(r["n"] for r in got) > 3_000_000 and max(r["n"] - r["most"] for r in got) <= 2 * 180_000
