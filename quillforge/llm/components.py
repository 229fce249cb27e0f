"""Connected components by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillforge.llm.stages import settle, tidy


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    near = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for each end of ``edges`` (a, b): the smallest node it reaches.

    Two stars a round, about log(nodes) rounds; every round is written to the checkpoint
    folder. Loops, doubled and null edges don't count. A round that changes no edge is the last;
    if ``rounds`` don't reach one, that is an error.
    """
    now = settle(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b").distinct())
    size = now.count()
    for _ in range(rounds):
        was, before = now, size
        now = settle(_small_star(_large_star(was)), before)
        size = now.count()
        tidy(edges.sparkSession)
        if size == before and now.join(was, ["a", "b"], "left_anti").isEmpty():
            break
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    members = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
