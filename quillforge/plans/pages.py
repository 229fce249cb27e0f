"""More page queries: boxes of lineitem in regions, orientation from conversations, headings, hashes, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillforge.functions import geometry as gm
from quillforge.functions import hashing as hs
from quillforge.functions import text as tx
from quillforge.operators import corpus as cp
from quillforge.operators import orientation as ori
from quillforge.operators import spatial as sp
from quillforge.operators import reading as rd
from quillforge.plans.inputs import duck, made
from quillforge.plans.layout import _BOX, boxes
from quillforge.plans.registry import query
from quillforge.tables import table

_T = f"t AS ({_BOX.format(0)})"


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two boxes of a page, made three times as large, as regions."""
    b = boxes(spark, sf_dir).where("ord <= 2")
    return b.select("page", "ord", "x", "y", (F.col("w") * 3).alias("w"), (F.col("h") * 3).alias("h"))


def _unique(b: DataFrame) -> DataFrame:
    """Boxes under a number that tells them apart (order lines repeat line numbers), each once."""
    n = F.col("ord") * 10**12 + F.col("x") * 10**9 + F.col("y") * 10**6 + F.col("w") * 1000 + F.col("h")
    return b.select("page", n.alias("ord"), *"xywh").distinct()


_U = f"{_T}, u AS (SELECT DISTINCT page, ord * 1000000000000 + x * 1000000000 + y * 1000000 + w * 1000 + h AS ord, x, y, w, h FROM t)"
_REGIONS = f"{_U}, g AS (SELECT page, ord, x, y, w * 3 AS w, h * 3 AS h FROM t WHERE ord <= 2)"


@query(
    f"""WITH {_REGIONS} SELECT u.page, u.ord, min(g.ord) AS region FROM u LEFT JOIN g ON u.page = g.page AND u.x + u.w / 2.0 BETWEEN g.x AND g.x + g.w AND u.y + u.h / 2.0 BETWEEN g.y AND g.y + g.h GROUP BY u.page, u.ord"""
)
def q_first_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.first_container(_unique(boxes(spark, sf_dir)), _regions(spark, sf_dir)).select("page", "ord", "region")


_CUT = "greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"


@query(f"WITH {_T} SELECT a.page, a.ord AS a, b.ord AS b, ({_CUT})::BIGINT AS area FROM t a JOIN t b ON a.page = b.page AND a.ord < b.ord AND a.ord % 3 <> b.ord % 3 WHERE {_CUT} > 0")
def q_class_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line number modulo 3 is the class of a box."""
    return sp.class_conflicts(boxes(spark, sf_dir).withColumn("class", F.col("ord") % 3))


@query(f"WITH {_REGIONS} SELECT a.page, a.ord, round(least(1.0, coalesce(sum({_CUT}), 0)::DOUBLE / any_value(a.w * a.h)), 6) AS share FROM u a LEFT JOIN g b ON a.page = b.page GROUP BY a.page, a.ord")
def q_excluded_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.excluded_share(_unique(boxes(spark, sf_dir)), _regions(spark, sf_dir)).withColumn("share", F.round("share", 6))


@query(f"WITH {_T}, c AS (SELECT page AS key, y + h / 2.0::DOUBLE AS centre, h FROM t), g AS (SELECT *, centre - lag(centre) OVER (PARTITION BY key ORDER BY centre) AS gap FROM c) SELECT key, coalesce(max(gap), 0) <= greatest(90.0, median(h) * 3.2) AS ok FROM g GROUP BY key")
def q_row_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(spark, sf_dir).select(F.col("page").alias("key"), (F.col("y") + F.col("h") / 2).alias("centre"), "h")
    return sp.spacing_ok(rows)


@query(
    f"""WITH {_T}, c AS (SELECT page, ord, unnest(range(y // 100, y // 100 + (h // 100 + 1))) AS r, x // 100 AS c0, w // 100 + 1 AS n FROM t), e AS (SELECT page, r, unnest(range(c0, c0 + n)) AS c FROM c)
SELECT page AS block, r, c, count(*) AS n FROM e GROUP BY ALL HAVING count(*) > 1"""
)
def q_cell_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes on a grid of 100 units as table cells."""
    at = lambda c: F.floor(F.col(c) / 100)
    cells = boxes(spark, sf_dir).select(F.col("page").alias("block"), "ord", at("y").alias("row"), at("x").alias("column"), (at("h") + 1).alias("row_span"), (at("w") + 1).alias("column_span"))
    return sp.cell_overlaps(cells)


@query()
def q_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rd.reading_order(boxes(spark, sf_dir))


@query()
def q_column_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of three columns of an order's page, by their numbers."""
    b = boxes(spark, sf_dir)
    thirds = b.withColumns({"x": F.lit(40) + F.col("ord") % 3 * 330, "w": F.col("w") % 200 + 60})
    return rd.column_bands(thirds)


_LINES = "l AS (SELECT conv_id AS page, (turn % 4 * 90)::INT AS degrees, len(regexp_replace(text, '\\s', '', 'g')) AS n, (turn % 7 + 1) / 8.0::DOUBLE AS confidence FROM conversations)"


@query(f"WITH {_LINES} SELECT page, degrees, sum(n)::BIGINT AS chars, round(coalesce(sum(confidence * n) / nullif(sum(n), 0), 0), 6) AS confidence, round(coalesce(sum(confidence * n) / nullif(sum(n), 0), 0) * ln(1 + sum(n)), 6) AS score FROM l GROUP BY page, degrees")
def q_orientation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as lines read at four turns of a page."""
    lines = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page"), (F.col("turn") % 4 * 90).cast("int").alias("degrees"), "text", ((F.col("turn") % 7 + 1) / 8.0).alias("confidence"))
    got = ori.line_stats(lines)
    return got.select("page", "degrees", "chars", F.round("confidence", 6).alias("confidence"), F.round("score", 6).alias("score"))


@query(
    f"""WITH {_LINES}, s AS (SELECT page, degrees, sum(n)::BIGINT AS chars, coalesce(sum(confidence * n) / nullif(sum(n), 0), 0) AS confidence FROM l GROUP BY page, degrees), t AS (SELECT *, confidence * ln(1 + chars) AS score FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, confidence DESC, chars DESC, degrees) AS k FROM t), g AS (SELECT page, max(score) FILTER (WHERE k = 1) - coalesce(max(score) FILTER (WHERE k = 2), 0) AS margin FROM r GROUP BY page),
u AS (SELECT page, score AS us, confidence AS uc, chars AS un FROM t WHERE degrees = 0), b AS (SELECT r.page, arg_min(degrees, k) AS turn FROM r LEFT JOIN u ON u.page = r.page WHERE degrees <> 0
AND score >= greatest(0.01, coalesce(us, 0) * 1.15) AND confidence >= coalesce(uc, 0) + 0.08 AND chars >= greatest(20, floor(coalesce(un, 0) * 0.5)) GROUP BY r.page)
SELECT g.page, coalesce(turn, 0) AS degrees, round(margin, 6) AS margin FROM g LEFT JOIN b ON b.page = g.page"""
)
def q_orientation_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page"), (F.col("turn") % 4 * 90).cast("int").alias("degrees"), "text", ((F.col("turn") % 7 + 1) / 8.0).alias("confidence"))
    return ori.choose(ori.line_stats(lines)).withColumn("margin", F.round("margin", 6))


@query(f"WITH {_T} SELECT page, ord, 1400 - y - h AS x, x AS y, h AS w, w AS h FROM t")
def q_box_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every box after a quarter turn of its page."""
    turned = gm.rotated(gm.Box.of(), F.lit(90), F.lit(1000), F.lit(1400))
    return boxes(spark, sf_dir).select("page", "ord", turned.x.alias("x"), turned.y.alias("y"), turned.w.alias("w"), turned.h.alias("h"))


@query("SELECT page_id, ('0x' || substr(sha256(url), 57, 8))::BIGINT % 64 AS slot FROM pages")
def q_lock_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", hs.lock_slot(F.col("url")).alias("slot"))


@query("SELECT page_id, url LIKE 'https://%' AS secure, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages")
def q_url_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", (F.parse_url(url, F.lit("PROTOCOL")) == "https").alias("secure"), F.parse_url(url, F.lit("HOST")).alias("host"))


_ITEMS = "SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN turn || '. ' || text WHEN 1 THEN '* ' || text WHEN 2 THEN '\u2022 ' || text ELSE text END AS item FROM {conversations}"


@query(rf"SELECT conv_id, turn, CASE WHEN regexp_matches(item, '^\d{{1,3}}[.)]\s+') THEN 'ordered' WHEN regexp_matches(item, '^[\x{{2022}}\x{{25AA}}\x{{25E6}}\x{{25CF}}*-]\s+') THEN 'bullet' END AS style FROM {duck(_ITEMS)}")
def q_prefix_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with marks of list items before three of four."""
    return made(spark, sf_dir, _ITEMS).select("conv_id", "turn", tx.prefix_style(F.col("item")).alias("style"))


@query(
    """WITH e AS (SELECT item_id, chr(1) || text AS p, unnest(range(length(text))) AS i FROM benchmark), n AS (SELECT substr(p, i::INT + 1, 1) AS context, substr(p, i::INT + 2, 1) AS token FROM e), c AS (SELECT context, token, count(*) AS n FROM n GROUP BY ALL)
SELECT context, string_agg(token || '=' || n, '|' ORDER BY encode(token)) AS followers FROM c GROUP BY context"""
)
def q_model_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bigram model with contexts and followers in order, as it is written."""
    return _export(cp.ngram_counts(table(spark, sf_dir, "benchmark"), "text", 2))


@query()
def q_corpus_model_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bigram model of all documents."""
    return _export(cp.corpus_ngram_counts(table(spark, sf_dir, "documents"), "text", 2))


def _export(model: DataFrame) -> DataFrame:
    counts = model.where("len = 1")
    pairs = F.array_sort(F.collect_list(F.struct("token", "n")))
    return counts.groupBy("context").agg(pairs.alias("f")).select("context", F.array_join(F.transform("f", lambda x: F.concat(x["token"], F.lit("="), x["n"].cast("string"))), "|").alias("followers"))
