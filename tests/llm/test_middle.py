import hashlib
import random
import re

from quillforge.llm import middle as mi

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text, rate=50, spm=80):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    h = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if doc_id is None or not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(6)
    out = ["".join(rng.choice(["a", "bc", " ", "  ", "\n", "\t", "中", "\U0001f600", "é", "<", "P>", "<S", "\x00", " "]) for _ in range(rng.randrange(60))) for _ in range(300)]
    return out + ["<P> marked", "with <M>", "   ", " x ", " ".join(f"w{i}" for i in range(9001)), " ".join(f"w{i}" for i in range(4096)), "z" * 200_000]


def test_against_plain_python(make):
    from tests.llm.conftest import rows

    data = rows(texts()) + rows([None, "", "again again"], first=900) + [(None, None, "no id here", 0.1, 1, "y", "en")]
    data += [data[3], data[3]]
    for rate in (50, 100):
        got = mi.fill_in_middle(make(data), rate=rate).collect()
        key = lambda r: tuple(str(x) for x in r)
        want = [(r[1], *plain(r[1], r[2], rate)) for r in data]
        assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got), key=key) == sorted(want, key=key)
        assert all(r["source"] == "s%d" % ((r["doc_id"] - 1) % 3) for r in got if r["doc_id"] and r["doc_id"] < 300 and r["source"])
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_the_query_restores_every_text(make, awkward, empty):
    from tests.llm.conftest import rows

    data = rows(texts())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {r["doc_id"]: r for r in mi.middle_query(make(data)).collect()}
    for r in data:
        assert got[r[1]]["restored_sha256"] == sha(r[2] or "") and got[r[1]]["output_sha256"] == sha(plain(r[1], r[2])[-1])
    assert mi.middle_query(empty).count() == 0
    assert mi.middle_query(awkward).count() == awkward.count()


def test_columns_with_names_of_its_own(make, spark):
    frame = spark.createDataFrame([(1, "some words to cut here", "x", 2, "y", {"a": 1})], "doc_id long, text string, form string, n int, output string, whole map<string,int>")
    got = mi.fill_in_middle(frame, rate=100)
    assert sorted(got.columns) == sorted(["doc_id", "text", "whole", "n", "form", "prefix_chars", "middle_chars", "output"])
    assert got.first()["whole"] == {"a": 1} and got.first()["n"] == 5


def test_no_python_in_the_plan(make):
    plan = mi.middle_query(make([]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
