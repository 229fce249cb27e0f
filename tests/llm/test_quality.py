import random
import zlib

import numpy as np

from quillforge.llm import quality as q

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=400, seed=9):
    rng = random.Random(seed)
    texts, marks = [], []
    for i in range(n):
        good = i % 3 > 0
        words = ["".join(rng.choice(["an", "er", "th", "on", "re"]) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(5, 60))]
        texts.append(" ".join(w if good else w.upper() + "!!" for w in words))
        marks.append(int(good))
    return texts, marks


def test_held_out_accuracy_and_repeatability(make, spark):
    from tests.llm.conftest import rows

    texts, marks = corpus()
    docs = make(rows(texts))
    labels = spark.createDataFrame([(i + 1, m, 0) for i, m in enumerate(marks)], LABELS)
    got = q.quality_query(spark, docs, labels).toPandas().sort_values("doc_id")
    held = np.array([zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]])
    assert (got["held_out"].to_numpy() == held).all() and held.any()
    assert (got["predicted"].to_numpy() == np.array(marks))[held].mean() > 0.97
    again = q.quality_query(spark, docs.repartition(3), labels).toPandas().sort_values("doc_id")
    assert np.allclose(got["score"], again["score"], atol=1e-9)


def test_held_out_labels_are_not_used(make, spark):
    from tests.llm.conftest import rows

    texts, marks = corpus(200)
    docs = make(rows(texts))
    flip = [(i + 1, 1 - m if zlib.crc32(str(i + 1).encode()) % 4 == 2 else m, 0) for i, m in enumerate(marks)]
    one = q.fit(docs, spark.createDataFrame([(i + 1, m, 0) for i, m in enumerate(marks)], LABELS))
    two = q.fit(docs, spark.createDataFrame(flip, LABELS))
    assert np.array_equal(one.w1, two.w1) and one.temperature == two.temperature


def test_awkward_rows_and_missing_labels(awkward, empty, spark):
    none = spark.createDataFrame([], LABELS)
    odd = spark.createDataFrame([(None, 1, 0), (4, None, 0), (5, 7, 0), (6, 1, 0), (6, 0, 0), (99, 1, 0)], LABELS)
    got = q.quality_query(spark, awkward, none).collect()
    assert len(got) == awkward.count() and {r["score"] for r in got} == {0.5}
    assert q.quality_query(spark, awkward, odd).count() == awkward.count()
    assert q.quality_query(spark, empty, odd).count() == 0


def plain_tokens(text):
    """(token bytes, shape) in order, by a loop over bytes."""
    kinds = {**{b: 0 for b in b" \t\n\x0b\x0c\r"}, **{b: 1 for b in range(256) if bytes([b]).isalnum() or b >= 128}}
    out, run, kind = [], b"", 0
    for b in text.encode() + b" ":
        k = kinds.get(b, 2)
        if k != kind and run:
            if kind:
                out.append((run, kind))
            run = b""
        run, kind = run + bytes([b]), k
    folded = [t.lower() if t.isascii() else bytes(b + 32 if 65 <= b <= 90 else b for b in t) for t, _ in out]
    result = []
    for i, (t, k) in enumerate(out):
        upper = [65 <= b <= 90 for b in t[:2]]
        if (i and folded[i - 1] == folded[i]) or (i > 1 and folded[i - 2] == folded[i] and k == 1):
            shape = 0
        elif upper[0]:
            shape = 1 if len(upper) > 1 and upper[1] else 2
        elif 48 <= t[0] <= 57:
            shape = 3
        else:
            shape = 4 if k == 2 and len(t) > 1 else 5
        result.append((folded[i], shape))
    return result


def plain_hash(token):
    mask = (1 << 64) - 1

    def finish(h):
        h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & mask
        h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & mask
        return h ^ (h >> 31)

    value = lambda b: finish((b + 1) * 0x9E3779B97F4A7C15 & mask) | 1
    total = sum(value(b) * pow(q.WORD_BASE, i, 1 << 64) for i, b in enumerate(token))
    return finish((total + len(token) * 0x9E3779B97F4A7C15) & mask)


def plain_entries(text):
    return [e for t, shape in plain_tokens(text) for e in (plain_hash(t) % q.BUCKETS, q.BUCKETS + shape)]


def plain_score(model, text):
    entries = plain_entries(text)
    x = np.zeros(q.DIM + 1)
    for e in entries:
        x[: q.DIM] += model.vectors[e]
    x[: q.DIM] /= max(1, len(entries))
    x[q.DIM] = np.log(1 + len(entries))
    z = [(x[d] - model.mean[d]) / model.scale[d] for d in range(q.DIM + 1)]
    hidden = [np.tanh(sum(z[d] * model.w1[d, h] for d in range(q.DIM + 1)) + model.b1[h]) for h in range(q.HIDDEN)]
    logit = sum(hidden[h] * model.w2[h] for h in range(q.HIDDEN)) + model.b2
    return 1 / (1 + np.exp(-logit / model.temperature))


def test_scores_against_plain_loops(make, spark, monkeypatch):
    from tests.llm.conftest import rows

    texts, marks = corpus(120)
    texts = texts + ["", None, "A", "a A  b a", "--- x!! 7 77 Ab AB aB ... ...", "Ünï İstanbul ſ", "z" * 300 + " " + "#" * 200]
    docs = make(rows(texts))
    labels = spark.createDataFrame([(i + 1, m, 0) for i, m in enumerate(marks)], LABELS)
    model = q.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in q.quality_scores(spark, docs, model).collect()}
    for i, t in enumerate(texts):
        assert abs(got[i + 1] - plain_score(model, t or "")) < 1e-9
    column = q.pa.array([t or "" for t in texts])
    monkeypatch.setattr(q, "CHUNK", 64)  # cuts inside documents change nothing
    assert np.allclose(model.score(*q.text_bytes(column)), [got[i + 1] for i in range(len(texts))], atol=1e-9)


def test_word_vectors_against_plain_loops(monkeypatch):
    texts = [t for t in corpus(30)[0]] + ["", "one", "x " * 40]
    index = q.index_vectors()
    want = np.zeros_like(index)
    for t in texts:
        e = plain_entries(t)
        for i in range(len(e)):
            for j in range(max(0, i - q.REACH), min(len(e), i + q.REACH + 1)):
                want[e[i]] += index[e[j]]
    for chunk in (q.CHUNK, 64):
        monkeypatch.setattr(q, "CHUNK", chunk)
        total = np.zeros_like(index)
        q.context_sums(*q.text_bytes(q.pa.array(texts)), index, total)
        assert np.array_equal(total, want)


def test_memory_of_long_documents():
    import subprocess
    import sys

    code = """
import resource, numpy as np, pyarrow as pa
from quillforge.llm import quality as q
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
v = q.index_vectors().astype(np.float32)
m = q.Model(v, np.zeros(q.DIM + 1), np.ones(q.DIM + 1), np.zeros((q.DIM + 1, q.HIDDEN)), np.zeros(q.HIDDEN), np.zeros(q.HIDDEN), 0.0, 1.0)
data = np.frombuffer(b"Some words, 12 more; " * 2_500_000, np.uint8)
m.score(data, np.array([0, len(data)]))
one = np.full(10_000_000, 120, np.uint8)
m.score(one, np.array([0, len(one)]))
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)
"""
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) < 500


def test_auc_on_held_out_labels(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    got = q.quality_query(spark, docs, labels).join(labels, "doc_id").where("held_out and quality is not null").toPandas()
    good, bad = got[got["quality"] == 1]["score"].to_numpy(), got[got["quality"] == 0]["score"].to_numpy()
    assert len(good) and len(bad)
    assert np.mean(good[:, None] > bad[None, :]) > 0.97
