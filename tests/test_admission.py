"""Admission decided in ranges of a manager's events against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from quillforge.plans.audits import _LOADS
from quillforge.plans.inputs import made
from quillforge.streaming import jobs as jb

EVENT = "manager long, ord long, kind string, n long"


def loop(rows, most_active, most_retained):
    state, out = {}, []
    for manager, ord_, kind, n in sorted(r for r in rows if r[0] is not None):
        s = state.setdefault(manager, jb.Admission(most_active, most_retained))
        out.append((manager, ord_, s.take(kind, n), s.active, s.retained))
    return out


@pytest.mark.parametrize("managers, most_active, most_retained, parts", [(1, 6, 20, 7), (3, 2, 3, 5), (40, 6, 20, 4), (2, 60, 400, 5), (1, 60, 60, 9)])
def test_admission_in_ranges(spark, managers, most_active, most_retained, parts):
    rng = random.Random(managers + parts)
    kinds = ["reserve"] * 3 + ["finish", "drop"]
    rows = [(rng.choice([*range(managers), managers * 10]) if managers > 1 else 4, i, rng.choice(kinds), rng.randrange(0, 5)) for i in range(1500)] + [(None, -1, "reserve", 1)]
    got = jb.admissions(spark.createDataFrame(rows, EVENT), "manager", most_active, most_retained, parts)
    assert sorted(map(tuple, got.select("manager", "ord", "refused", "active", "retained").collect())) == loop(rows, most_active, most_retained)
    if managers == 1:
        assert got.select(F.spark_partition_id().alias("p")).distinct().count() == parts  # not one task


def test_ends_of_less_than_no_job(spark):
    rows = [(1, i, "finish" if i % 3 else "reserve", i % 5 - 2) for i in range(60)]
    got = jb.admissions(spark.createDataFrame(rows, EVENT), "manager", 2, 4, 3)
    assert sorted(map(tuple, got.select("manager", "ord", "refused", "active", "retained").collect())) == loop(rows, 2, 4)


def test_users_share_ten_managers(spark):
    assert made(spark, "/root/testdata/sf0.001", _LOADS).agg(F.max("manager"), F.countDistinct("manager")).first()[:] == (9, 10)
