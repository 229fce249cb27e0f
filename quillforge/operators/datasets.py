"""Dataset operators: validation, reports, readiness, reviews, campaigns. Rows: id, document_id, split, subset, tags, status, sha256, path."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillforge.functions import hashing as hs
from quillforge.functions import text as tx


def violations(samples: DataFrame) -> DataFrame:
    """(rule, id, detail) of every broken rule; all rules run over one scan but the grouped ones."""
    rules: list[tuple[str, Column]] = [
        ("unsafe-path", ~tx.safe_relative(F.col("path"))),
        ("bad-hash", ~hs.is_sha256(F.col("sha256"))),
        ("empty-text", F.trim(F.coalesce("text", F.lit(""))) == ""),
        ("bad-tag", F.exists("tags", lambda t: ~t.rlike("^[a-z0-9][a-z0-9-]*$"))),
    ]
    broken = F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules)))
    single = samples.select(F.explode(broken).alias("rule"), F.col("id").cast("string").alias("id"), F.lit("").alias("detail"))
    twice = samples.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate-id").alias("rule"), F.col("id").cast("string").alias("id"), F.col("n").cast("string").alias("detail"))
    leaks = leakage(samples).select(F.lit("split-leakage").alias("rule"), F.col("document_id").alias("id"), F.col("splits").alias("detail"))
    equal = duplicates(samples).select(F.lit("duplicate-hash").alias("rule"), F.col("sha256").alias("id"), F.col("n").cast("string").alias("detail"))
    return reduce(DataFrame.unionByName, (single, twice, leaks, equal))


def is_real_source(tags: Column) -> Column:
    """Whether tags prove a real source: a real document, or a real capture with optical evidence."""
    has = lambda t: F.array_contains(tags, t)
    return has("source:real-document") | (has("source:real-capture") & has("capture:optical-evidence"))


def leakage(samples: DataFrame) -> DataFrame:
    sets = samples.groupBy("document_id").agg(F.array_sort(F.collect_set("split")).alias("s"))
    return sets.where(F.size("s") > 1).select("document_id", F.array_join("s", ",").alias("splits"))


def duplicates(samples: DataFrame) -> DataFrame:
    groups = samples.where("sha256 is not null").groupBy("sha256").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))
    return groups.where("first <> last").select("sha256", "n")


def axis_counts(samples: DataFrame) -> DataFrame:
    """Rows for each value of split, subset, status and tag, and of license and language where ``samples`` has them, from one scan."""
    one = lambda kind, value: F.struct(F.lit(kind).alias("axis"), F.coalesce(value.cast("string"), F.lit("unknown")).alias("value"))
    singles = F.array(*(one(k, F.col(k)) for k in ("split", "subset", "status", "license", "language") if k in samples.columns))
    every = F.concat(singles, F.transform("tags", lambda t: one("tag", t)))
    return samples.select(F.explode(every).alias("a")).groupBy("a.axis", "a.value").agg(F.count("*").alias("n"))


def report_totals(samples: DataFrame, required: list[str]) -> DataFrame:
    """One row: samples and documents, reviews by outcome and the share approved, layouts and their share, captures per document, documents
    by split (that of a document's first sample), and which of the ``required`` subsets have no sample.

    ``samples``: id, document_id, split, subset, status and has_layout. Samples are counted per document first. Without samples the counts are 0 and the shares null.
    """
    has = F.coalesce(F.col("has_layout"), F.lit(False))
    status = lambda s: F.count_if(F.col("status") == s)
    each = samples.groupBy("document_id").agg(F.count("*").alias("captures"), F.min_by("split", "id").alias("split"), status("approved").alias("a"), status("rejected").alias("r"), status("unreviewed").alias("u"), F.count_if(has).alias("l"), F.collect_set("subset").alias("subsets"))
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0))
    n = whole("captures")
    splits = {f"{s}_documents": F.count_if(F.col("split") == s) for s in ("train", "development", "test")}
    there = F.array_distinct(F.flatten(F.collect_set("subsets")))
    return each.agg(
        n.alias("samples"), F.count("*").alias("documents"), whole("a").alias("approved"), whole("r").alias("rejected"), whole("u").alias("unreviewed"), F.try_divide(whole("a"), n).alias("approved_ratio"),
        whole("l").alias("layout_samples"), F.count_if(F.col("l") > 0).alias("layout_documents"), F.try_divide(whole("l"), n).alias("layout_ratio"),
        F.min("captures").alias("captures_min"), F.max("captures").alias("captures_max"), F.avg("captures").alias("captures_mean"), *(c.alias(k) for k, c in splits.items()),
        F.array_sort(F.array_except(F.array(*map(F.lit, required)), there)).alias("missing_subsets"),
    )


def coverage_matrix(samples: DataFrame, splits: list[str]) -> DataFrame:
    return samples.groupBy("subset").pivot("split", splits).agg(F.count(F.lit(1))).na.fill(0)


def readiness(samples: DataFrame, dimensions: dict[str, tuple[list[str], list[str], int]]) -> DataFrame:
    """Distinct approved documents for each dimension (subsets, tags, least number), and whether they suffice.

    A dimension with a pending or rejected sample isn't ready, whatever it covers.
    """
    hits = [F.when(F.col("subset").isin(subsets) | F.arrays_overlap("tags", F.array(*map(F.lit, tags))), F.lit(name)) for name, (subsets, tags, _) in dimensions.items()]
    rows = samples.select("document_id", "status", F.explode(F.array_compact(F.array(*hits))).alias("dimension"))
    counts = rows.groupBy("dimension").agg(F.countDistinct(F.when(F.col("status") == "approved", F.col("document_id"))).alias("documents"), F.count_if(F.col("status") != "approved").alias("open"))
    need = F.create_map(*(x for name, (_, _, n) in dimensions.items() for x in (F.lit(name), F.lit(n))))
    return counts.withColumn("needed", F.element_at(need, F.col("dimension"))).withColumn("ready", (F.col("documents") >= F.col("needed")) & (F.col("open") == 0))


def review_status(quality: Column) -> Column:
    return F.when(quality == 1, "approved").when(quality == 0, "rejected").otherwise("unreviewed")


def upsert_reviews(samples: DataFrame, decisions: DataFrame) -> DataFrame:
    """``samples`` with the new status where a decision has one; decisions without a sample change nothing."""
    return samples.join(decisions.select("id", F.col("status").alias("new")), "id", "left").withColumn("status", F.coalesce("new", "status")).drop("new")


def apply_reviews(samples: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(samples, violations) after review decisions (id, status), all or none: with a decision on an unknown sample, two on one or an unknown
    status the samples stay as they are. Nothing is written, so this is the dry run too."""
    per = decisions.groupBy("id").agg(F.count("*").alias("n"), F.min("status").alias("status"))
    twice = per.where("n > 1").select("id", F.lit("decided twice").alias("problem"))
    odd = decisions.where(~F.coalesce(F.col("status").isin("approved", "rejected"), F.lit(False))).select("id", F.lit("unknown status").alias("problem"))
    bad = twice.unionByName(odd).unionByName(unknown_decisions(samples, per).select("id", F.lit("unknown sample").alias("problem")))
    any_bad = bad.agg((F.count("*") > 0).alias("__bad"))
    both = samples.join(per.select("id", F.col("status").alias("__new")), "id", "left").join(F.broadcast(any_bad), F.lit(True))  # one row
    return both.withColumn("status", F.when(~F.col("__bad"), F.coalesce("__new", "status")).otherwise(F.col("status"))).drop("__new", "__bad"), bad


def review_summary(decisions: DataFrame) -> DataFrame:
    """One row: decisions, and those that approve and reject."""
    return decisions.agg(F.count("*").alias("decision_count"), F.count_if(F.col("status") == "approved").alias("approved_count"), F.count_if(F.col("status") == "rejected").alias("rejected_count"))


def unknown_decisions(samples: DataFrame, decisions: DataFrame) -> DataFrame:
    return decisions.join(samples.select("id"), "id", "left_anti")


def campaign(pages: DataFrame, modes: list[str], captured: DataFrame) -> DataFrame:
    """Every page with every mode and whether ``captured`` (page, mode) has it."""
    wanted = pages.select("page", F.explode(F.array(*map(F.lit, modes))).alias("mode"))
    have = captured.select("page", "mode").distinct().withColumn("have", F.lit(True))
    return wanted.join(have, ["page", "mode"], "left").withColumn("present", F.coalesce("have", F.lit(False))).drop("have")
