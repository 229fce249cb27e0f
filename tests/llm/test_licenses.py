import re

import duckdb

from quillforge.llm import licenses as li

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_against_sql(make, spark):
    from tests.llm.conftest import rows

    texts = [
        "This work is licensed under the GNU General Public License, version 3. " * 2,
        "Released under the MIT License.",
        "foo CC BY-NC 4.0. cc by cc by CC-BY; LICENSED UNDER CC BY NC 4 0",
        "all rights reserved. All Rights\nReserved all rights",
        "Apache License only, then licensed under the apache license version 2 0",
        "general public licence / general public license",
        "the mit licenseé is not a match; mit license is",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        None,
        "",
        "été cc by straße",
        "\u212a\u212a cc by",
    ] + ["nothing to see %d" % i for i in range(20)]
    data = rows(texts)
    got = li.licenses_query(make(data)).toPandas().sort_values("doc_id")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(r[1], r[2]) for r in data])
    cur = con.execute(li.oracle())
    names = [c[0] for c in cur.description]
    want = sorted(cur.fetchall())
    assert [tuple(None if v != v else v for v in r) for r in got[names].itertuples(index=False)] == want
    assert got["labels"].iloc[1] == "mit" and got["labels"].iloc[0] == "gpl,gpl-3.0" and got["score"].iloc[1] == 1.0


def test_awkward_rows(awkward, empty):
    got = li.licenses_query(awkward).collect()
    assert len(got) == awkward.count()
    words = [len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r["text"] or "").translate(FOLD))) for r in awkward.collect()]
    assert [r["n_words"] for r in got] == words
    assert li.licenses_query(empty).count() == 0
    assert {"score", "shard", "size"} <= set(li.scan(awkward).columns)


def test_any_number_of_templates_gives_one_plan(make):
    import re

    from tests.llm.conftest import rows

    texts = [f"head t{i}a t{i}b common words t{i}c tail" for i in range(60)] + ["common words t3c", "t3a common", None, ""]
    frame = make(rows(texts))
    plans = []
    for n in (2, 60):
        templates = tuple((f"l{i}", f"t{i}a t{i}b common words t{i}c", (f"t{i}b common", f"t{i}c")) for i in range(n))
        got = li.scan(frame, templates)
        assert {r["doc_id"]: r["method_labels"] for r in got.collect()} == {k + 1: [f"l{k}"] if k < n else [] for k in range(len(texts))}
        plans.append(re.sub(r"#\d+L?|\d+", "", got._jdf.queryExecution().optimizedPlan().toString()))
    assert plans[0] == plans[1]
