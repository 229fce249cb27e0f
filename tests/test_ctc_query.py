"""The beam query against a plain beam search over whole sequences."""

import datetime
import math
import random

import pytest

from quillforge.plans import catalog


def plain_beam(lattice, width):
    """Prefix beam search in plain probabilities: prefix -> (ends in a blank, ends in a label)."""
    beams = {(): (1.0, 0.0)}
    for step in lattice:
        grown = {}
        for prefix, (blank, label) in beams.items():
            moves = [(prefix, (blank + label) * step[0], 0.0)]
            for k in range(1, len(step)):
                again = bool(prefix) and prefix[-1] == k
                moves.append(((*prefix, k), 0.0, (blank if again else blank + label) * step[k]))
                if again:
                    moves.append((prefix, 0.0, label * step[k]))
            for key, b, n in moves:
                old = grown.get(key, (0.0, 0.0))
                grown[key] = (old[0] + b, old[1] + n)
        beams = dict(sorted(grown.items(), key=lambda kv: -sum(kv[1]))[:width])
    prefix, ends = max(beams.items(), key=lambda kv: sum(kv[1]))
    return list(prefix), math.log(sum(ends))


def lattice(values):
    rows = [[0.05 + abs(math.sin(v * (k + 1))) for k in range(5)] for v in values]
    return [[x / sum(row) for x in row] for row in rows]


def test_query_decodes_whole_sequences_at_width_ten(spark, tmp_path):
    rng = random.Random(6)
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    values = {u: [round(rng.uniform(0, 100), 2) for _ in range(n)] for u, n in enumerate((1, 3, 40, 70, 70, 90))}
    rows = [(u * 1000 + i, u, start + datetime.timedelta(hours=9 * i), v) for u, vs in values.items() for i, v in enumerate(vs)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["user_id"]: r for r in catalog.QUERIES["q_ctc_beam"](spark, str(tmp_path)).collect()}
    assert len(got) == len(values)
    narrow = 0
    for u, vs in values.items():
        labels, log_prob = plain_beam(lattice(vs), 10)
        assert got[u]["labels"] == ",".join(map(str, labels))
        assert got[u]["log_prob"] == pytest.approx(log_prob, abs=1e-5)
        narrow += plain_beam(lattice(vs), 4) != (labels, log_prob)
    assert narrow  # the fixture tells the widths apart
