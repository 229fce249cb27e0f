"""The bounded sampler against one sequential fold."""

import random

import pytest

from quillforge.operators import corpus as cp


def plain(rows, limit, per_document, max_documents):
    seen, out, docs, current, got = set(), [], 0, None, 0
    for doc, pos, line in sorted(rows, key=lambda r: r[:2]):
        if doc != current:
            current, got, docs = doc, 0, docs + 1
        if got < per_document and len(out) < limit and (max_documents is None or docs <= max_documents) and line not in seen:
            seen.add(line)
            got += 1
            out.append((doc, pos, line))
    return out


@pytest.mark.parametrize("limit, per_document, max_documents", [(40, 2, None), (500, 3, None), (500, 2, 37), (1, 1, None), (10_000, 100, 60)])
def test_ranges_give_what_one_fold_gives(spark, limit, per_document, max_documents):
    rng = random.Random(limit)
    rows = [(d * 3, p, rng.choice([f"line {rng.randrange(60)}", f"own {d} {p}", "very common"])) for d in range(120) for p in range(rng.randrange(1, 9))]
    frame = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "doc_id long, pos long, line string")
    want = plain(rows, limit, per_document, max_documents)
    for range_lines, wave in ((60, 4), (100_000, 2)):
        got = [tuple(r) for r in cp.bounded_sample(frame, limit, per_document, max_documents, range_lines, wave).collect()]
        assert sorted(got) == want
    assert cp.bounded_sample(frame.where("false"), limit, per_document).count() == 0
