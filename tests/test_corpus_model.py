"""The language model of all documents against plain Python and against the general operators."""

import math
import random
import unicodedata
from collections import Counter

import pytest

from quillforge.operators import corpus as cp
from quillforge.plans import catalog

TEXTS = ["abcabca", "", None, "é\U0001f600 \U0010ffff\u0e81b", "abc\nab\x01c", "a", "e\u0301", "abcabca", "x" * 3000 + "é"]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder


def plain(order=3):
    counts = Counter()
    for t in TEXTS:
        p = "\x01\x01" + (t or "")
        counts.update((k, p[i - k : i], p[i]) for i in range(2, len(p)) for k in range(order))
    return counts


@pytest.mark.parametrize("block", [1, 5, 1_000_000])
def test_counts(spark, docs, monkeypatch, block):
    monkeypatch.setattr(cp, "_BLOCK", block)
    got = catalog.QUERIES["q_corpus_ngram_counts"](spark, docs).collect()
    assert len(got) == len(plain()) and {(r["len"], r["context"], r["token"]): r["n"] for r in got} == plain()


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_scores_every_document(spark, docs, monkeypatch, most):
    monkeypatch.setattr(cp, "_BROADCAST", most)
    counts = plain()
    total = Counter()
    for (k, c, _), n in counts.items():
        total[k, c] += n
    want = {}
    for i, t in enumerate(TEXTS):
        p = "\x01\x01" + (t or "")
        if t:
            want[i] = (sum(math.log((counts[2, p[j - 2 : j], p[j]] + 0.1) / (total[2, p[j - 2 : j]] + 20)) for j in range(2, len(p))), len(t))
    got = {r["doc_id"]: r for r in catalog.QUERIES["q_corpus_ngram_score"](spark, docs).collect()}
    assert set(got) == set(want)
    for i, (log_prob, n) in want.items():
        assert got[i]["n_chars"] == n and got[i]["log_prob"] == pytest.approx(log_prob, abs=1e-3)


def test_export_and_vocabulary(spark, docs):
    want = {}
    for (k, c, t), n in sorted(plain(2).items()):
        if k == 1:
            want.setdefault(c, []).append(f"{t}={n}")
    got = {r["context"]: r["followers"] for r in catalog.QUERIES["q_corpus_model_export"](spark, docs).collect()}
    assert got == {c: "|".join(f) for c, f in want.items()}
    chars = sorted({c for t in TEXTS for c in unicodedata.normalize("NFC", t or "")} - {"\n", "\r"})
    assert [r["char"] for r in catalog.QUERIES["q_corpus_vocabulary"](spark, docs).orderBy("id").collect()] == chars


def test_the_same_as_the_general_operators(spark):
    d = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    counts = cp.ngram_counts(d, "text", 3)
    assert sorted(map(tuple, cp.corpus_ngram_counts(d, "text", 3).collect())) == sorted(map(tuple, counts.collect()))
    want = {r[0]: (round(r[1], 6), r[2]) for r in cp.backoff_scores(d, "text", "doc_id", counts, 3, 200).collect()}
    assert {r[0]: (round(r[1], 6), r[2]) for r in cp.corpus_scores(d, "text", "doc_id", 200).collect()} == want


def test_models_of_one_to_six_characters(spark):
    rng = random.Random(9)
    words = lambda letters, n: ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 30))) for _ in range(n)]
    corpus = spark.createDataFrame(list(enumerate([*words("ab é\U0001f600\n", 30), None, "x"])), "id long, text string")
    other = spark.createDataFrame(list(enumerate([*words("abé中\U0001f600", 12), None, "", "zzz"])), "id long, text string")
    for order in range(1, 7):
        want = cp.ngram_counts(corpus, "text", order)
        grams = cp.packed_grams(corpus, "text", order)
        counted = lambda f: sorted((r["len"], r["context"], r["token"], r["n"]) for r in f.collect())
        assert counted(cp.model_counts(grams, order)) == counted(want)
        scored = lambda f: {r["id"]: (round(r["log_prob"], 8), r["n_chars"]) for r in f.collect()}
        got = scored(cp.model_scores(other, "text", "id", grams, order, 50))
        assert got == scored(cp.backoff_scores(other, "text", "id", want, order, 50)) and len(got) >= 10
    empty = cp.packed_grams(corpus.where("false"), "text", 4)
    got = cp.model_scores(other.where("id = 14"), "text", "id", empty, 4, 50).first()
    assert abs(got["log_prob"] + 3 * math.log(50)) < 1e-9 and got["n_chars"] == 3
    for bad in (0, 7):
        with pytest.raises(ValueError):
            cp.packed_grams(corpus, "text", bad)
