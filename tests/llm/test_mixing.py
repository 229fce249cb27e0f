import random
from itertools import product

import pytest

from quillforge.llm import mixing as m


def test_targets():
    got = m.targets([("b", 10), (None, 1000), ("a", 10), ("c", 100)])
    assert [s for s, _, _ in got] == ["a", "b", "c", None]
    assert [g for _, _, g in got] == pytest.approx([30, 30, 1060 / 6, 1060 * 5 / 6])
    assert sum(g for _, _, g in got) == pytest.approx(1120)
    assert m.targets([]) == []
    assert m.targets([("x", 0)])[0][2] == 0


def test_budget_is_exact_within_the_table():
    rng = random.Random(2)
    for _ in range(60):
        counts = [(s, rng.randrange(0, 4)) for s in rng.sample(range(1, 40), 4)]
        budget = rng.randrange(0, 150)
        take = m.fit_budget(counts, budget)
        assert all(0 <= take.get(s, 0) <= n for s, n in counts)
        best = min(abs(budget - sum(s * k for (s, _), k in zip(counts, ks, strict=True))) for ks in product(*(range(n + 1) for _, n in counts)))
        assert abs(budget - sum(s * k for s, k in take.items())) == best


def test_large_budgets_come_near():
    rng = random.Random(3)
    counts = [(s, rng.randrange(1, 200)) for s in range(1, 900)]
    whole = sum(s * n for s, n in counts)
    for share in (0.01, 0.37, 0.8, 0.999):
        budget = int(whole * share)
        take = m.fit_budget(counts, budget)
        assert all(take[s] <= n for s, n in counts)
        assert abs(sum(s * k for s, k in take.items()) - budget) <= 1


@pytest.mark.parametrize("rank_rows", [20_000, 7])
def test_frame(make, monkeypatch, rank_rows):
    from tests.llm.conftest import rows

    monkeypatch.setattr(m, "RANK_ROWS", rank_rows)
    rng = random.Random(4)
    data = rows([" ".join(["w"] * rng.choice([3, 3, 3, 5, 17, 40])) + f" id{i}" for i in range(300)])
    got = m.mix_query(make(data)).toPandas()
    again = m.mix_query(make(list(reversed(data))).repartition(3)).toPandas()
    assert got.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))
    assert len(got) == len(data) and ((got["taken"] % got["size"]) == 0).all() and (got["taken"] <= 3 * got["size"]).all()
    source = {r[1]: r[0] for r in data}
    got["source"] = got["doc_id"].map(source).fillna("null")
    for _, part in got.groupby("source"):
        assert part["size"].sum() == part["source_size"].iloc[0]
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= 2


def test_awkward_rows(awkward, empty):
    got = m.mix_query(awkward).collect()
    assert len(got) == awkward.count()
    mixed = m.mix(awkward)
    assert mixed.select("doc.*").columns == awkward.columns and {"size", "repeats"} <= set(mixed.columns)
    assert m.mix_query(empty).count() == 0


def test_clashing_names(spark):
    names = ["doc_id", "text", "source", "base", "more", "ranges", "before", "p_size", "key", "doc", "size", "place", "range", "mix_size", "__x", "a.b", "Target"]
    docs = spark.createDataFrame([(i, "w " * (i % 4), "s", *([i] * (len(names) - 3))) for i in range(40)], names)
    got = m.mix(docs)
    assert got.select("doc.*").columns == names
    assert sorted(r["doc"]["base"] for r in got.collect()) == list(range(40))


def test_a_larger_table_is_exact_for_larger_budgets():
    rng = random.Random(5)
    counts = [(rng.randrange(900, 5_000) * 7 + 3, rng.randrange(1, 4)) for _ in range(12)]
    counts = list({s: n for s, n in counts}.items())
    budget = sum(s * n for s, n in counts) * 2 // 5
    sums = {0}
    for s, n in counts:
        sums = {x + s * k for x in sums for k in range(n + 1)}
    best = min(abs(budget - x) for x in sums)
    take = m.fit_budget(counts, budget, dp_budget=budget)
    assert abs(budget - sum(s * k for s, k in take.items())) == best
    near = m.fit_budget(counts, budget)
    assert abs(budget - sum(s * k for s, k in near.items())) <= min(s for s, _ in counts)
