"""Choosing a page's turn from recognition results of each candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How much better a turned page must read.
LEAST_SCORE, BETTER_SCORE, BETTER_CONFIDENCE, LEAST_CHARS, CHARS_SHARE = 0.01, 1.15, 0.08, 20, 0.5


def line_stats(lines: DataFrame) -> DataFrame:
    """Per page and turn: non-blank characters, mean confidence weighted by them, score = confidence * ln(1 + characters)."""
    n = F.char_length(F.regexp_replace("text", r"(?U)\s", ""))
    sums = lines.withColumn("n", n).groupBy("page", "degrees").agg(F.sum("n").alias("chars"), F.try_divide(F.sum(F.col("confidence") * F.col("n")), F.sum("n")).alias("confidence"))
    return sums.withColumn("confidence", F.coalesce("confidence", F.lit(0.0))).withColumn("score", F.col("confidence") * F.log1p("chars"))


def line_geometry(lines: DataFrame, *keys: str) -> DataFrame:
    """Counts of lines along both axes and their solid characters, and whether sideways text prevails, by ``keys`` (page if none).

    Lines of fewer than two characters, square ones and those without a size are ignored.
    """
    n = F.char_length(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s", ""))
    w, h = F.col("w").cast("double"), F.col("h").cast("double")
    sound = (n >= 2) & (F.least(w, h) > 0) & (w != h) & (F.greatest(w, h) < float("inf"))
    axis = F.when(F.coalesce(sound, F.lit(False)), F.when(w > h, "horizontal").otherwise("vertical"))
    each = lines.withColumns({"axis": axis, "n": n})
    chars = lambda a: F.coalesce(F.sum(F.when(F.col("axis") == a, F.col("n"))), F.lit(0)).cast("long")
    got = each.groupBy(*(keys or ("page",))).agg(*(F.count_if(F.col("axis") == a).alias(f"{a}_lines") for a in ("horizontal", "vertical")), *(chars(a).alias(f"{a}_characters") for a in ("horizontal", "vertical")), F.count_if(F.col("axis").isNull()).alias("ignored_lines"))
    return got.withColumn("sideways", (F.col("vertical_lines") >= 2) & (F.col("vertical_characters") > F.col("horizontal_characters")))


#: Confidence from which no other turn is tried, and confidence, characters and share of the script that do as well.
SURE, SCRIPT_SURE, SCRIPT_CHARS, SCRIPT_SHARE = 0.65, 0.45, 200, 0.75


def skip_reason(confidence: Column, chars: Column, script_share: Column, sideways: Column) -> Column:
    """Why other turns need not be tried: high confidence, or a baseline mostly in the script; null where they must, as sideways text always must."""
    reason = F.when(confidence >= SURE, "high-confidence").when((confidence >= SCRIPT_SURE) & (chars >= SCRIPT_CHARS) & (script_share >= SCRIPT_SHARE), "lao-dominant-baseline")
    return F.when(~sideways, reason)


def acceptable(score: Column, confidence: Column, chars: Column, upright_score: Column, upright_confidence: Column, upright_chars: Column) -> Column:
    enough = chars >= F.greatest(F.lit(LEAST_CHARS), F.floor(upright_chars * CHARS_SHARE))
    return (score >= F.greatest(F.lit(LEAST_SCORE), upright_score * BETTER_SCORE)) & (confidence >= upright_confidence + BETTER_CONFIDENCE) & enough


def choose(stats: DataFrame) -> DataFrame:
    """One turn for each page: the best acceptable one, else upright; with the margin to the runner-up."""
    rank = F.row_number().over(Window.partitionBy("page").orderBy(F.desc("score"), F.desc("confidence"), F.desc("chars"), "degrees"))
    ranked = stats.withColumn("rank", rank)
    margin = ranked.groupBy("page").agg((F.max(F.when(F.col("rank") == 1, F.col("score"))) - F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(0.0))).alias("margin"))
    up = stats.where("degrees = 0").select("page", F.col("score").alias("us"), F.col("confidence").alias("uc"), F.col("chars").alias("un"))
    tried = ranked.where("degrees <> 0").join(up, "page", "left").na.fill(0, ["us", "uc", "un"])
    good = tried.where(acceptable(F.col("score"), F.col("confidence"), F.col("chars"), F.col("us"), F.col("uc"), F.col("un")))
    best = good.groupBy("page").agg(F.min_by("degrees", "rank").alias("turn"))
    return margin.join(best, "page", "left").select("page", F.coalesce("turn", F.lit(0)).alias("degrees"), "margin")


def parse_turns(text: Column) -> Column:
    """Array of (page, degrees) from "page:degrees" parts; null if a part is wrong, doubled or not a right angle."""
    parts = F.split(text, r"\s*,\s*")
    pairs = F.transform(parts, lambda p: F.struct(F.expr("1").alias("k"), F.try_to_number(F.regexp_extract(p, r"^(\d{1,6}):(\d{1,3})$", 1), F.lit("999999")).cast("int").alias("page"), F.try_to_number(F.regexp_extract(p, r"^(\d{1,6}):(\d{1,3})$", 2), F.lit("999")).cast("int").alias("degrees")))
    ok = F.forall(pairs, lambda s: s["page"].isNotNull() & (s["page"] > 0) & s["degrees"].isin(0, 90, 180, 270))
    single = F.size(F.array_distinct(F.transform(pairs, lambda s: s["page"]))) == F.size(pairs)
    return F.when(ok & single, F.transform(pairs, lambda s: F.struct(s["page"].alias("page"), s["degrees"].alias("degrees"))))
