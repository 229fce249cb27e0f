"""Page assembly queries: turns of conversations as lines of pages, in tables, lists, headings and paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillforge.functions import text as tx
from quillforge.operators import borderless as bl
from quillforge.operators import layout as lo
from quillforge.operators import paragraphs as pg
from quillforge.operators import rasters as ra
from quillforge.operators import tables as tb
from quillforge.plans.inputs import FLAT as _FLAT
from quillforge.plans.inputs import duck, made
from quillforge.plans.registry import query
from quillforge.tables import table

#: Every conversation is a page, every turn a row: role, length and whole text, their left edges off by a little. Some numbers are missing, some are
#: two rows tall (the next row has none then), some roles reach into the second column.
_CELLS = """SELECT page, page_width, ord, text, confidence, x, y, w, h FROM (SELECT conv_id AS page, 1000 AS page_width, turn, inline(array(
named_struct('ord', turn * 3, 'text', role, 'confidence', 0.5e0, 'x', 40 + turn % 2 * 5, 'y', turn * 40, 'w', CASE WHEN turn % 7 = 6 THEN 360 ELSE 120 END, 'h', 20),
CASE WHEN turn % 5 = 4 OR turn % 7 = 6 OR (conv_id % 4 = 1 AND turn = 1) THEN NULL ELSE named_struct('ord', turn * 3 + 1, 'text', CAST(length(text) AS STRING), 'confidence', 0.75e0, 'x', 300, 'y', turn * 40, 'w', 100, 'h', CASE WHEN turn % 5 = 3 THEN 62 ELSE 20 END) END,
named_struct('ord', turn * 3 + 2, 'text', text, 'confidence', 0.25e0, 'x', 560, 'y', turn * 40, 'w', 300, 'h', 20))) FROM {conversations} WHERE text IS NOT NULL) WHERE ord IS NOT NULL"""


@query()
def q_borderless_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = bl.borderless_tables(made(spark, sf_dir, _CELLS))
    return got.select("page", "block", "rows", "columns", "merged_cells", "empty_cells", "x", "y", "w", "h", F.sha2("text", 256).alias("text_sha256"), F.size("lines").alias("lines"))


@query()
def q_region_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as one region that a layout model has called a table."""
    got = tb.region_tables(made(spark, sf_dir, _CELLS).withColumn("block", F.lit(1).cast("long")))
    return got.select("page", "block", "rows", "columns", "empty_cells", "x", "y", "w", "h", F.sha2("text", 256).alias("text_sha256"))


@query()
def q_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of aligned tables."""
    cells = bl.borderless_tables(made(spark, sf_dir, _CELLS)).select("page", "block", F.explode("cells").alias("c"))
    return cells.select("page", "block", "c.row", "c.column", "c.row_span", "c.column_span", F.sha2("c.text", 256).alias("text_sha256"))


@query()
def q_table_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All aligned tables against those of whole regions, matched by their boxes."""
    lines = made(spark, sf_dir, _CELLS)
    ref, pred = (t.withColumn("ord", F.col("block")) for t in (bl.borderless_tables(lines), tb.region_tables(lines.withColumn("block", F.lit(0).cast("long")))))
    matches = lo.greedy(lo.candidates(ref, pred, 0.5))
    side = lambda t: t.select("page", "ord", "rows", "columns", "cells")
    got = lo.table_metrics(side(ref), side(pred), matches)
    return got.select("ref_tables", "pred_tables", "matched", "same_shape", "hits", *(F.round(c, 6).alias(c) for c in ("shape_accuracy", "cell_precision", "cell_recall", "cell_f1")))


#: Every turn is a paragraph of its role and one of its whole text; some are tall, some are list items, some have a hint. Texts are single lines.
_PROSE = """SELECT conv_id AS page, 1000 AS page_width, 1 AS block, turn * 2 + k AS paragraph, turn AS line, turn * 2 + k AS ord, 0.9e0 AS confidence, 40 AS x, CAST(turn * 50 + k * 25 AS INT) AS y, 600 AS w, CASE WHEN k = 1 THEN 20 WHEN turn % 4 < 2 THEN 36 WHEN turn % 4 = 2 THEN 31 ELSE 20 END AS h,
CASE WHEN k = 0 THEN role WHEN turn % 5 = 1 THEN turn || '. ' || text WHEN turn % 5 = 2 THEN '- ' || text ELSE text END AS text, CASE WHEN k = 0 THEN NULL WHEN turn % 7 = 3 THEN 'heading' WHEN turn % 7 = 4 THEN 'list' WHEN turn % 7 = 6 THEN 'table' END AS hint FROM {conversations} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) WHERE text IS NOT NULL"""


@query(
    rf"""WITH l AS (SELECT *, {_FLAT.format("replace(text, chr(10), ' ')")} AS t FROM {duck(_PROSE)}), m AS (SELECT page, median(h) AS typical FROM l GROUP BY page),
p AS (SELECT l.page, paragraph, list(t ORDER BY line) FILTER (WHERE t <> '') AS parts, count(*) AS n, median(h) / greatest(1.0, any_value(typical)) AS ratio, list_distinct(list(hint) FILTER (WHERE hint IS NOT NULL)) AS hints FROM l JOIN m ON m.page = l.page GROUP BY l.page, paragraph),
s AS (SELECT *, array_to_string(parts, chr(10)) AS body, list_transform(parts, lambda t: CASE WHEN regexp_matches(t, '^\d{{1,3}}[.)]\s+') THEN 'ordered' WHEN regexp_matches(t, '^[\x{{2022}}\x{{25AA}}\x{{25E6}}\x{{25CF}}*-]\s+') THEN 'bullet' END) AS styles, CASE WHEN len(hints) = 1 THEN hints[1] END AS hint FROM p WHERE len(parts) > 0),
k AS (SELECT *, styles[1] IS NOT NULL AND len(list_distinct(list_filter(styles, lambda x: x IS NOT NULL))) = 1 AS listed FROM s),
c AS (SELECT *, CASE WHEN listed THEN 'list' WHEN hint IS NOT NULL THEN hint WHEN n <= 2 AND length(body) <= 160 AND ratio >= 1.3 THEN 'heading' ELSE 'paragraph' END AS type FROM k)
SELECT page, paragraph, type, CASE WHEN type = 'heading' THEN CASE WHEN ratio >= 1.75 THEN 1 WHEN ratio >= 1.5 THEN 2 ELSE 3 END END AS level, CASE WHEN listed THEN styles[1] WHEN type = 'list' THEN 'unresolved' END AS list_style,
CASE WHEN listed THEN len(list_filter(styles, lambda x: x IS NOT NULL)) WHEN type = 'list' THEN len(parts) END AS items, sha256(body) AS text_sha256 FROM c"""
)
def q_paragraph_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = made(spark, sf_dir, _PROSE).withColumn("text", F.translate("text", "\n", " "))
    got = pg.paragraph_blocks(lines)
    return got.select("page", "paragraph", "type", "level", "list_style", F.when(F.col("items").isNotNull(), F.size("items")).cast("long").alias("items"), F.sha2("text", 256).alias("text_sha256"))


#: Below the prose of a page: its turns as an aligned table, as a region with a hint, and in a ruled grid of two columns.
_BELOW = f"""SELECT page, page_width, 2 AS block, 100 + ord AS paragraph, 0 AS line, 100 + ord AS ord, confidence, x, 700 + y AS y, w, h, text, CAST(NULL AS STRING) AS hint FROM ({_CELLS})
UNION ALL SELECT conv_id, 1000, 3, 200 + turn * 2 + k, 0, 200 + turn * 2 + k, 0.5e0, 40 + k * 360, 1300 + turn * 40, 200, 20, CASE k WHEN 0 THEN role ELSE text END, 'table' FROM {{conversations}} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) WHERE text IS NOT NULL
UNION ALL SELECT conv_id, 1000, 4, 300 + turn * 2 + k, 0, 300 + turn * 2 + k, 0.5e0, 120 + k * 300, 1924 + turn * 60, 200, 20, CASE k WHEN 0 THEN role ELSE text END, NULL FROM {{conversations}} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) WHERE text IS NOT NULL"""
#: Each turn paints the rules around its two cells.
_RULES = """SELECT conv_id AS page, 1000 AS page_width, 2600 AS page_height, inline(array(named_struct('x', 100, 'y', 1900 + turn * 60, 'w', 803, 'h', 3), named_struct('x', 100, 'y', 1960 + turn * 60, 'w', 803, 'h', 3),
named_struct('x', 100, 'y', 1900 + turn * 60, 'w', 3, 'h', 63), named_struct('x', 400, 'y', 1900 + turn * 60, 'w', 3, 'h', 63), named_struct('x', 900, 'y', 1900 + turn * 60, 'w', 3, 'h', 63))) FROM {conversations} WHERE text IS NOT NULL"""


@query()
def q_page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages in reading order: ruled tables, tables of hinted regions, aligned tables, then what is left as paragraphs.

    source: 0 paragraphs, 1 ruled, 2 hinted, 3 aligned. A page of one or two turns has too low a grid to count as ruled.
    """
    lines = made(spark, sf_dir, _PROSE)
    names = ["page", "page_width", "block", "paragraph", "line", "ord", "confidence", "x", "y", "w", "h", "text", "hint"]
    lines = lines.select(*names).unionByName(made(spark, sf_dir, _BELOW).select(*names)).withColumn("text", F.translate("text", "\n", " "))
    ruled = ra.ruled_blocks(ra.ruled_grids(made(spark, sf_dir, _RULES)), lines.where("block = 4"))
    got = pg.page_blocks(lines, ruled)
    return got.select("page", "place", "source", "type", "level", "x", "y", "w", "h", F.sha2("text", 256).alias("text_sha256"))


_EDGES = "SELECT CAST(floor(conv_id / 5) AS BIGINT) AS document, conv_id AS page, 1000 AS page_height, turn AS ord, CASE WHEN turn % 9 = 4 THEN 'table' ELSE 'paragraph' END AS type, CASE WHEN turn % 3 = 0 THEN role || ' ' ELSE text END AS text, CAST(turn * 137 % 1000 AS INT) AS y, 30 AS h FROM {conversations} WHERE text IS NOT NULL"
_MARKED = rf"""b AS (SELECT *, CASE WHEN type = 'table' THEN '' ELSE {_FLAT.format('text')} END AS plain, y <= 1000 * 0.12 AS t, y + h >= 1000 * (1 - 0.12) AS f FROM {duck(_EDGES)}), n AS (SELECT document, count(DISTINCT page) AS pages FROM b GROUP BY document),
c AS (SELECT document, plain, count(DISTINCT page) FILTER (WHERE t) AS tops, count(DISTINCT page) FILTER (WHERE f) AS feet FROM b WHERE plain <> '' GROUP BY document, plain),
r AS (SELECT b.*, CASE WHEN plain <> '' AND t AND tops >= greatest(2, floor(pages * 0.3 + 0.999999)) THEN 'header' WHEN plain <> '' AND f AND feet >= greatest(2, floor(pages * 0.3 + 0.999999)) THEN 'footer' END AS role FROM b JOIN n USING (document) LEFT JOIN c USING (document, plain))"""


@query(f"WITH {_MARKED} SELECT page, ord, role FROM r")
def q_block_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as pages of documents of five: texts that repeat in the bands of a third of their pages."""
    return pg.with_roles(made(spark, sf_dir, _EDGES), share=0.3).select("page", "ord", "role")


@query(f"WITH {_MARKED}, d AS (SELECT document, plain, min(page * 100000 + ord) AS k FROM r WHERE role = 'header' GROUP BY document, plain) SELECT document, string_agg(plain, '|' ORDER BY k) AS texts FROM d GROUP BY document")
def q_role_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = pg.with_roles(made(spark, sf_dir, _EDGES), share=0.3)
    return pg.role_texts(marked, "header").select("document", F.array_join("texts", "|").alias("texts"))


_LISTED = "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '1. ' || lang ELSE '* ' || lang END AS a, CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN '2) ' || source ELSE '- ' || source END AS b, CASE doc_id % 5 WHEN 0 THEN ' more ' ELSE '33. x' END AS c FROM {documents}"


@query(
    rf"""WITH l AS (SELECT doc_id, [a, b, c] AS t FROM {duck(_LISTED)}), s AS (SELECT doc_id, t, list_transform(t, lambda x: CASE WHEN regexp_matches(x, '^\d{{1,3}}[.)]\s+') THEN 'ordered' WHEN regexp_matches(x, '^[*-]\s+') THEN 'bullet' END) AS s FROM l),
o AS (SELECT *, s[1] IS NOT NULL AND coalesce(s[2], s[1]) = s[1] AND coalesce(s[3], s[1]) = s[1] AS ok, list_transform(t, lambda x: trim(regexp_replace(x, '^(\d{{1,3}}[.)]|[*-])\s+', ''))) AS p FROM s)
SELECT doc_id, CASE WHEN ok THEN s[1] END AS style, CASE WHEN ok THEN p[1] || CASE WHEN s[2] IS NULL THEN ' ' ELSE '|' END || p[2] || CASE WHEN s[3] IS NULL THEN ' ' ELSE '|' END || p[3] END AS items FROM o"""
)
def q_list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.array("a", "b", "c")
    return made(spark, sf_dir, _LISTED).select("doc_id", tx.list_style(lines).alias("style"), F.array_join(tx.list_items(lines), "|").alias("items"))
