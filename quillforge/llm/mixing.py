"""Mixing sources to target weights by subset-sum budget fitting.

Whole documents only: a source whose target is r times its size takes each
document floor(r) times and fits the rest of the budget with a subset of its
documents. The subset is found on the table of (size, number of documents):
a proportional share of each size first, then larger sizes greedily, then a
bounded-knapsack table of reachable sums (binary-split counts, bits of one
integer) that closes the last budget as well as any choice can. Which documents
of a size are taken is decided by a seeded hash.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillforge.llm.stages import settle

MOST = 3
WEIGHTS = (5.0, 2.0, 1.0)
#: Words that the knapsack table covers at the end of a budget; a larger table is exact for larger budgets.
DP_BUDGET = 20_000
#: Documents of one size of one source that one task ranks at a time, about.
RANK_ROWS = 1_000
#: Different (source, size) pairs up to which the plan is broadcast (about 100 bytes each).
BROADCAST_KINDS = 200_000
SEED = 17


def word_count(text: Column) -> Column:
    """Words parted by ASCII blanks; a null text has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> list[tuple[str | None, int, float]]:
    """(source, size, target): sources by code point, null last, weigh ``weights`` in turn and share the sum of all sizes.

    A target stops at ``most`` times its source's size; what is left over is shared by weight among the others, again and again.
    """
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = [weights[k % len(weights)] for k in range(len(order))]
    left, goal = float(sum(s for _, s in order)), [0.0] * len(order)
    free = list(range(len(order)))
    while free:
        whole = sum(weight[k] for k in free)
        over = [k for k in free if left * weight[k] / whole > most * order[k][1]]
        if not over:
            for k in free:
                goal[k] = left * weight[k] / whole
            break
        for k in over:
            goal[k] = float(most * order[k][1])
        left -= sum(goal[k] for k in over)
        free = [k for k in free if k not in set(over)]
    return [(s, n, g) for (s, n), g in zip(order, goal, strict=True)]


def target_table(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``sizes`` (source, source_size) with its target. One group holds a row for each source, never documents."""

    def share(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = [(None if pd.isna(s) else s, int(n)) for s, n in zip(pdf["source"], pdf["source_size"], strict=True)]
        return pd.DataFrame(targets(pairs, weights, most), columns=["source", "source_size", "target"])

    return sizes.groupBy(F.lit("all")).applyInPandas(share, "source string, source_size long, target double")


def fit_budget(counts: list[tuple[int, int]], budget: int, dp_budget: int = DP_BUDGET) -> dict[int, int]:
    """How many documents of each size to take so that the sum comes as near ``budget`` as can be found.

    Exact (no choice comes nearer) while ``budget`` is at most ``dp_budget``. Beyond it a proportional share of every
    size is taken first, and the table closes what is left, which lies between a quarter of ``dp_budget`` and all of it
    (or every document is taken): the sum then misses by no more than the smallest size with a document left, mostly by nothing.
    """
    counts = [(s, n) for s, n in sorted(counts, reverse=True) if s > 0 and n > 0]
    whole = sum(s * n for s, n in counts)
    take = {s: 0 for s, _ in counts}
    if budget <= 0 or not counts:
        return take
    left = budget
    if left > dp_budget:
        share = (left - dp_budget // 2) / whole
        for s, n in counts:
            take[s] = min(n, int(n * min(1.0, share)))
        left -= sum(s * k for s, k in take.items())
        for s, n in counts:
            if left <= dp_budget // 2:
                break
            more = min(n - take[s], (left - dp_budget // 4) // s)
            if more > 0:
                take[s] += more
                left -= s * more
    if left <= 0:
        return take
    # reachable sums, with one entry for each binary part of a count
    span = left + max(s for s, _ in counts)
    full = (1 << (span + 1)) - 1
    reach, parts = 1, []
    for s, n in sorted(counts):
        rest, part = min(n - take[s], span // s), 1
        while rest > 0:
            k = min(part, rest)
            before = reach
            reach |= (reach << (s * k)) & full
            if reach != before:
                parts.append((s, k, before))
            rest, part = rest - k, part * 2
        if reach >> left & 1:
            break
    low = (reach & ((1 << (left + 1)) - 1)).bit_length() - 1
    above = reach >> (left + 1)
    high = left + 1 + ((above & -above).bit_length() - 1) if above else None
    goal = high if high is not None and high - left < left - low else low
    for s, k, before in reversed(parts):
        if not before >> goal & 1:
            goal -= s * k
            take[s] += k
    return take


def plan(lengths: DataFrame, goals: DataFrame, most: int = MOST, dp_budget: int = DP_BUDGET) -> DataFrame:
    """(source, size) -> base repeats for every document and how many of its documents get one more.

    One task holds the (size, count) pairs of a source: as many as it has different sizes, not documents.
    """
    joined = lengths.join(goals, F.col("source").eqNullSafe(F.col("g_source")), "inner")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        base = min(most, int(target // size)) if size else 0
        counts = list(zip(pdf["size"].astype(int), pdf["n"].astype(int), strict=True))
        more = fit_budget(counts, round(target - base * size), dp_budget) if base < most else {}
        return pdf[["source", "size", "n", "source_size", "target"]].assign(base=base, more=[more.get(s, 0) for s, _ in counts])

    kinds = "source string, size long, n long, source_size long, target double, base long, more long"
    return joined.groupBy("source").applyInPandas(choose, kinds)


def mix(docs: DataFrame, seed: int = SEED, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, dp_budget: int = DP_BUDGET) -> DataFrame:
    """The columns of ``docs`` as a struct ``doc``, with size, source_size, target and repeats (0 to ``most``).

    Null texts have size 0 and are taken ``base`` times like others of their source; a
    null source is a source of its own, last in order. Repeated rows are told
    apart by doc_id and text where they differ; equal rows may trade places, which changes nothing. Columns
    of ``docs`` may have any names. An empty table gives no rows.
    Equal inputs give equal results. A size that many documents share is ranked in
    hash ranges of about ``RANK_ROWS`` rows.
    """
    source, text = F.col("source").cast("string"), F.col("text")
    key = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.coalesce(F.xxhash64(text.cast("string")), F.lit(0)))
    sized = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), source.alias("source"), word_count(text).alias("size"), key.alias("key"))
    lengths = settle(docs.select(source.alias("source"), word_count(text).alias("size")).groupBy("source", "size").agg(F.count("*").alias("n")))
    sizes = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = target_table(sizes, weights, most).withColumnRenamed("source", "g_source")
    ranges = F.ceil(F.col("n") / RANK_ROWS)
    decided = settle(plan(lengths, goals, most, dp_budget).select(F.col("source").alias("p_source"), F.col("size").alias("p_size"), "source_size", "target", "base", "more", ranges.alias("ranges")))
    if decided.count() <= BROADCAST_KINDS:
        decided = F.broadcast(decided)
    rows = sized.join(decided, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size")), "inner")
    rows = rows.withColumn("range", F.when(F.col("ranges") <= 1, F.lit(0)).otherwise(F.pmod(F.shiftrightunsigned("key", 20), F.col("ranges"))))
    group = ["source", "size", "range"]
    place = F.row_number().over(Window.partitionBy(*group).orderBy("key", "doc.doc_id"))
    if not decided.where("ranges > 1").isEmpty():
        split = rows.where("ranges > 1").groupBy(*group).agg(F.count("*").alias("k"))
        prior = Window.partitionBy("source", "size").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        prior = split.select(F.col("source").alias("b_source"), F.col("size").alias("b_size"), F.col("range").alias("b_range"), F.coalesce(F.sum("k").over(prior), F.lit(0)).alias("before"))
        rows = rows.withColumn("place", place)
        rows = rows.join(prior, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("size") == F.col("b_size")) & (F.col("range") == F.col("b_range")), "left")
        place = F.col("place") + F.coalesce(F.col("before"), F.lit(0))
    return rows.select("doc", "size", "source_size", "target", (F.col("base") + (place <= F.col("more")).cast("long")).alias("repeats"))


def mix_query(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken words of every document; awkward rows as ``mix`` says."""
    return mix(docs.select("doc_id", "text", "source")).select("doc.doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))
