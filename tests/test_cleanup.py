"""Timed cleanup: a plain loop over seconds, the table form and the stream, which survives restarts."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from quillforge.streaming import cleanup as cl


def outcome(job, stage, failures):
    """Some stages fail a few times."""
    return failures >= zlib.crc32(f"{job}{stage}".encode()) % 4


def plain(rows, until, retention, delay):
    """Second by second."""
    out = []
    for manager in {m for m, _, _ in rows}:
        held, waiting, jobs = {}, {}, sorted((t, j) for m, j, t in rows if m == manager)
        for second in range(1, until + 1):
            if second % delay:
                continue
            for t, j in jobs:
                if t <= second and j not in held and (j not in waiting) and not any(o[2] == j and o[0] == manager for o in out):
                    held[j] = t
            for j in sorted(j for j, t in held.items() if t <= second - retention):
                held.pop(j)
                waiting[j] = [second, 0, True, True]
                out.append((manager, second, j, "expired", 0, True, True, second))
            for j in sorted((j for j, w in waiting.items() if w[0] <= second), key=lambda j: (waiting[j][0], j))[:8]:
                w = waiting[j]
                w[2] = w[2] and not outcome(j, "artifact", w[1])
                w[3] = w[3] and not outcome(j, "workspace", w[1])
                if w[2] or w[3]:
                    w[1] += 1
                    w[0] = second + min(30 * 2 ** min(w[1] - 1, 7), 3600)
                    out.append((manager, second, j, "retry", w[1], w[2], w[3], w[0]))
                else:
                    waiting.pop(j)
                    out.append((manager, second, j, "cleaned", w[1], False, False, None))
    return set(out)


def some_jobs():
    rng = random.Random(4)
    return [(m, f"{m}{i}", rng.randrange(1, 900)) for m in ("a", "b") for i in range(40)] + [("c", "c0", 333)]


def collected(rows):
    got = [(r["manager"], r["at"], r["job_id"], r["act"], r["failures"], r["artifact"], r["workspace"], r["retry_at"]) for r in rows]
    assert len(got) == len(set(got))
    return set(got)


def test_table_form(spark):
    rows = some_jobs()
    frame = spark.createDataFrame(rows + [("a", None, 5), ("a", "x", None)], "manager string, job_id string, ended_at int")
    want = plain(rows, 3000, 300, 60)
    assert collected(cl.cleanup(frame, 3000, outcome, 300, 60).collect()) == want
    assert {"expired", "retry", "cleaned"} == {w[3] for w in want} and max(sum(w[1] == t and w[3] != "expired" and w[0] == "a" for w in want) for t in range(0, 3001, 60)) == 8
    assert cl.cleanup(frame.where("false"), 3000, outcome).count() == 0
    early = [w for w in want if w[1] <= 780]  # some have failed by then, some haven't been tried
    last = {}
    for w in sorted(early, key=lambda w: (w[1], w[3] != "expired")):
        last[w[0], w[2]] = w
    count = lambda m, rule: sum(rule(w) for (k, _), w in last.items() if k == m)
    tries = lambda m, acts: sum(w[0] == m and w[3] in acts for w in early)
    waits = lambda w: w[3] != "cleaned"
    plain_figures = {(m, count(m, lambda w: True), count(m, waits), count(m, lambda w: waits(w) and w[5]), tries(m, ("retry", "cleaned")), tries(m, ("retry",))) for m in {w[0] for w in early}}
    assert {tuple(r) for r in cl.figures(cl.cleanup(frame, 780, outcome, 300, 60)).collect()} == plain_figures and any(0 < f[3] < f[2] for f in plain_figures)


@pytest.mark.parametrize("cuts", [(0, 10_000), (0, 200, 420, 421, 800, 2000, 10_000)])
def test_the_stream_makes_the_same_passes_over_restarts(spark, tmp_path, cuts):
    rows, schema = some_jobs() + [("z", f"tick{t}", t) for t in range(0, 4001, 500)], "manager string, job_id string, ended_at int"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for a, b in zip(cuts, cuts[1:]):
        mine = spark.createDataFrame([r for r in rows if a <= r[2] < b], schema).withColumn("ended", F.timestamp_seconds("ended_at"))
        mine.select("manager", "job_id", "ended").coalesce(1).write.mode("append").parquet(folder)
        source = spark.readStream.schema("manager string, job_id string, ended timestamp").parquet(folder)
        q = cl.cleanup_stream(source, outcome, 300, 60).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        assert q.awaitTermination(300) and q.exception() is None
    got = collected(spark.read.parquet(out).where("manager <> 'z'").collect())
    assert got == plain(some_jobs(), 4000, 300, 60)
