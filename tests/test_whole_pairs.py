"""Edit metrics over whole turns in every script, against plain Python."""

import random

import pytest

from quillforge.plans import catalog


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.fixture(scope="module")
def turns(spark, tmp_path_factory):
    rng = random.Random(5)
    long = ["".join(rng.choices("abc ກຂé\U0001f600", k=n)) for n in (0, 3, 350, 420, 420)]
    same = "x" * 200
    rows = [(c, t, ("user", "assistant")[t % 2], text) for c in (1, 2) for t, text in enumerate([*rng.sample(long, 5), same + "one", same + "two", "", "", "café", "café"])]
    folder = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    text = {(c, t): x for c, t, _, x in rows}
    return folder, [(c, t, r, x, text[c, t + 1]) for c, t, r, x in rows if (c, t + 1) in text]


def test_pairs_are(spark, turns):
    folder, want = turns
    got = {r["sample_id"]: (r["char_edits"], r["n_chars"]) for r in catalog.QUERIES["q_cer_pairs"](spark, folder).collect()}
    assert got == {c * 100 + t: (distance(a, b), len(a)) for c, t, _, a, b in want}
    got = {r["sample_id"]: (r["word_edits"], r["n_words"]) for r in catalog.QUERIES["q_wer_pairs"](spark, folder).collect()}
    assert got == {c * 100 + t: (distance(a.split(), b.split()), len(a.split())) for c, t, _, a, b in want}


def test_reports_are(spark, turns):
    folder, want = turns
    cer = lambda rows: sum(distance(a, b) for *_, a, b in rows) / sum(len(a) for *_, a, _ in rows)
    got = {(r["kind"], r["name"]): r for r in catalog.QUERIES["q_cer_by_axis"](spark, folder).collect()}
    for role in ("user", "assistant"):
        rows = [w for w in want if w[2] == role]
        assert got["subset", role]["samples"] == len(rows) and got["subset", role]["cer"] == pytest.approx(cer(rows), abs=1e-6)
    assert got["tag", "long"]["samples"] == sum(len(w[3]) > 100 for w in want)
    lines = {r["subset"]: (r["samples"], r["exact"], r["empty"]) for r in catalog.QUERIES["q_line_metrics"](spark, folder).collect()}
    assert lines == {role: (sum(w[2] == role for w in want), sum(w[2] == role and w[3] == w[4] for w in want), sum(w[2] == role and w[4] == "" for w in want)) for role in ("user", "assistant")}
    slices = {(r["kind"], r["name"]): r for r in catalog.QUERIES["q_compare_slices"](spark, folder).collect()}
    base, new = cer([w for w in want if w[0] == 2]), cer([w for w in want if w[0] == 1])
    assert slices["overall", "all"]["baseline"] == pytest.approx(base, abs=1e-6) and slices["overall", "all"]["candidate"] == pytest.approx(new, abs=1e-6)
    gate = catalog.QUERIES["q_compare_gate"](spark, folder).first()
    assert gate["slices"] == len(slices) and gate["improved"] == (new < base) and gate["no_regression"] == all(r["passed"] for r in slices.values())
