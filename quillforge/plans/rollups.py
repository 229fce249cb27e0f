"""Roll-up queries: suites, freezes, layout entries, reviews, telemetry, bundles and sessions over inputs made from the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillforge.functions import values as vl
from quillforge.operators import orientation as ori
from quillforge.operators import rollups as ro
from quillforge.plans.evaluation import _CODED, _SAMPLES, samples, turn_pairs
from quillforge.plans.inputs import FLAT as _FLAT
from quillforge.plans.inputs import duck, made
from quillforge.plans.layout import _BOX, boxes
from quillforge.plans.registry import query
from quillforge.tables import table

_SOURCES = "SELECT page_id AS source, CASE WHEN page_id % 5 = 0 THEN 'error' WHEN page_id % 7 = 0 THEN NULL ELSE 'ok' END AS status, CASE WHEN page_id % 3 = 0 THEN NULL WHEN page_id % 3 = 1 THEN 'native' ELSE '' END AS text_layer FROM {pages}"
_PAGES = """SELECT user_id AS source, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS layer_gap, CASE WHEN value < 20 THEN 'low' WHEN value < 60 THEN 'medium' ELSE 'high' END AS band, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'raster' END AS media,
event_id % 6 = 0 AS probed, CASE WHEN event_id % 12 = 0 THEN 90 END AS recommended, CASE WHEN event_id % 5 > 0 THEN CAST(90 * (event_id % 2) AS INT) END AS turned, CASE WHEN event_id % 5 > 0 THEN event_id % 2 = 0 END AS skipped,
CASE WHEN event_id % 4 = 0 THEN 'high-confidence' END AS skip_reason, CASE WHEN event_id % 7 = 0 THEN 'fast' END AS strategy, event_id % 100 AS native_chars, event_id % 130 AS ocr_chars, value AS seconds,
CASE WHEN event_id % 6 = 0 THEN value / 100 END AS probe_margin, CASE WHEN event_id % 5 > 0 THEN value / 50 END AS orientation_margin FROM {events}"""


@query(
    f"""WITH s AS {duck(_SOURCES)}, p AS {duck(_PAGES)} SELECT axis, value, count(*) AS n FROM (
SELECT 'source_statuses' AS axis, coalesce(status, 'unknown') AS value FROM s UNION ALL SELECT 'registry_text_layers', CASE WHEN coalesce(text_layer, '') = '' THEN 'unknown' ELSE text_layer END FROM s
UNION ALL SELECT 'layer_gap_classifications', layer_gap FROM p UNION ALL SELECT 'ocr_confidence_bands', band FROM p UNION ALL SELECT 'page_media_classifications', media FROM p
UNION ALL SELECT 'rotation_recommendations', coalesce(recommended::VARCHAR, 'none') FROM p WHERE probed UNION ALL SELECT 'applied_auto_orientations', turned::VARCHAR FROM p
UNION ALL SELECT 'auto_orientation_probe_states', CASE WHEN skipped THEN coalesce(skip_reason, 'skipped') ELSE 'probed' END FROM p WHERE skipped IS NOT NULL
UNION ALL SELECT 'auto_orientation_strategies', coalesce(strategy, 'unknown') FROM p WHERE skipped IS NOT NULL) WHERE value IS NOT NULL GROUP BY axis, value"""
)
def q_suite_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as sources of a suite, events as its sampled pages."""
    return ro.suite_counts(made(spark, sf_dir, _SOURCES), made(spark, sf_dir, _PAGES))


_MARGINS = "round(min({0}), 6) AS {0}_min, round(avg({0}), 6) AS {0}_mean, round(max({0}), 6) AS {0}_max, count({0}) AS {0}_samples"


@query(
    f"""WITH s AS (SELECT count(*) AS sources, count(*) FILTER (WHERE status = 'ok') AS ok FROM {duck(_SOURCES)}), p AS (SELECT count(*) AS sampled_pages, sum(native_chars)::BIGINT AS native_chars, sum(ocr_chars)::BIGINT AS ocr_chars, round(sum(seconds), 3) AS seconds,
{_MARGINS.format('probe_margin')}, {_MARGINS.format('orientation_margin')} FROM {duck(_PAGES)}) SELECT *, sources - ok AS errors, ocr_chars - native_chars AS ocr_minus_native FROM s, p"""
)
def q_suite_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ro.suite_totals(made(spark, sf_dir, _SOURCES), made(spark, sf_dir, _PAGES))
    return got.withColumns({c: F.round(c, 6) for c in got.columns if c.endswith(("_min", "_mean", "_max"))}).withColumn("seconds", F.round("seconds", 3))


@query(f"WITH {_SAMPLES} SELECT axis, value, count(*) AS n FROM (SELECT 'subset' AS axis, subset AS value FROM s WHERE split = 'test' UNION ALL SELECT 'tag', unnest(tags) FROM s WHERE split = 'test') GROUP BY axis, value")
def q_freeze_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ro.freeze_counts(samples(spark, sf_dir), "test")


@query(f"WITH {_SAMPLES} SELECT count(*) AS sample_count, count(DISTINCT document_id) AS document_count, string_agg(DISTINCT document_id, ',' ORDER BY document_id) AS documents FROM s WHERE split = 'test'")
def q_freeze_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ro.freeze_summary(samples(spark, sf_dir), "test")
    return got.select("sample_count", "document_count", F.array_join("document_ids", ",").alias("documents"))


_MARKED = "SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'test' ELSE 'train' END AS split, CASE WHEN doc_id % 3 = 0 THEN 'source:real-document' WHEN doc_id % 3 = 1 THEN 'source:real-capture' ELSE 'source:other' END AS one, CASE WHEN doc_id % 5 = 0 THEN 'capture:optical-evidence' ELSE lang END AS two, CASE WHEN doc_id % 2 = 0 THEN 'approved' WHEN doc_id % 7 = 0 THEN 'rejected' END AS status FROM {documents}"


@query(
    f"""WITH m AS {duck(_MARKED)} SELECT id, problem FROM (SELECT id, 'no real source' AS problem FROM m WHERE split = 'test' AND NOT (one = 'source:real-document' OR (one = 'source:real-capture' AND two = 'capture:optical-evidence'))
UNION ALL SELECT id, 'not approved' FROM m WHERE split = 'test' AND status IS DISTINCT FROM 'approved')"""
)
def q_freeze_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, sf_dir, _MARKED).withColumn("tags", F.array("one", "two"))
    return ro.freeze_blockers(rows, "test", real=True, reviewed=True)


_KIND = "CASE l_partkey % 5 WHEN 0 THEN 'heading' WHEN 1 THEN 'paragraph' WHEN 2 THEN 'list' WHEN 3 THEN 'table' ELSE 'image' END"
_ENTRIES = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'train' WHEN o_orderkey % 3 = 1 THEN 'dev' ELSE 'test' END AS split, CASE WHEN o_custkey % 4 > 0 THEN 'layout.json' END AS layout_ground_truth, o_orderstatus AS subset, CASE WHEN o_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS tag FROM {orders}"
_BLOCKS = f"SELECT l_orderkey AS id, {_KIND} AS type FROM {{lineitem}}"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, sf_dir, _ENTRIES).withColumn("tags", F.array("tag")).drop("tag")
    pages = rows.select("id", F.lit(1000).alias("width"), F.lit(1400).alias("height"))
    return ro.layout_entries(rows, pages, made(spark, sf_dir, _BLOCKS), ["train", "dev"])


_CHOSEN = f"e AS (SELECT * FROM {duck(_ENTRIES)} WHERE layout_ground_truth IS NOT NULL AND split IN ('train', 'dev')), b AS {duck(_BLOCKS)}, c AS (SELECT id, type, count(*) AS n FROM b GROUP BY ALL)"


@query(f"WITH {_CHOSEN} SELECT e.id, split, subset, 1000 AS width, 1400 AS height, coalesce(string_agg(type || '=' || n, ',' ORDER BY type), '') AS counts FROM e LEFT JOIN c ON e.id = c.id GROUP BY e.id, split, subset")
def q_layout_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as samples with layout ground truth, their lines as its blocks."""
    pairs = F.transform(F.map_entries("block_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return _entries(spark, sf_dir).select("id", "split", "subset", "width", "height", F.array_join(pairs, ",").alias("counts"))


@query(
    f"""WITH {_CHOSEN} SELECT axis, value, sum(n)::BIGINT AS n FROM (SELECT 'split' AS axis, split AS value, 1 AS n FROM e UNION ALL SELECT 'subset', subset, 1 FROM e UNION ALL SELECT 'tag', tag, 1 FROM e
UNION ALL SELECT 'block_type', type, n FROM c JOIN e ON e.id = c.id) GROUP BY axis, value"""
)
def q_layout_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ro.layout_summary(_entries(spark, sf_dir))


_CLASSES = {"heading": 1, "paragraph": 2, "list": 3, "table": 4, "image": 5}


@query(f"SELECT page, row_number() OVER (PARTITION BY page ORDER BY ord, x, y, w, h) - 1 AS \"order\", CASE type WHEN 'heading' THEN 1 WHEN 'paragraph' THEN 2 WHEN 'list' THEN 3 WHEN 'table' THEN 4 ELSE 5 END AS class_id, type AS class_name, x, y FROM ({_BOX.format(0)})")
def q_box_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    unique = boxes(spark, sf_dir).withColumn("ord", F.struct("ord", "x", "y", "w", "h"))
    return ro.box_targets(unique, _CLASSES).select("page", F.col("order").cast("long").alias("order"), "class_id", "class_name", "x", "y")


_KINDS = ", ".join(f"count(*) FILTER (WHERE type = '{t}') AS {t}" for t in _CLASSES)
_CONFIDENT = f"SELECT l_suppkey AS document, {_KIND} AS type, CASE WHEN l_linenumber % 3 > 0 THEN (l_partkey % 100) / 100e0 END AS confidence FROM {{lineitem}}"


@query(f"SELECT document, {_KINDS}, count(confidence) AS confidence_samples, round(avg(confidence), 6) AS mean_block_confidence FROM {duck(_CONFIDENT)} GROUP BY document")
def q_document_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ro.document_stats(made(spark, sf_dir, _CONFIDENT)).withColumn("mean_block_confidence", F.round("mean_block_confidence", 6))


_PROBES = "SELECT event_id, event_id % 3 = 0 AS has_lines, CASE WHEN event_id % 4 > 0 THEN value / 100 END AS line_confidence, event_id % 50 - 3 AS line_chars, value / 10 AS line_score, CASE WHEN event_id % 5 > 0 THEN value / 200 END AS block_confidence, event_id % 70 AS letters FROM {events}"


@query(
    f"""SELECT event_id, round(c, 6) AS confidence, n AS characters, round(CASE WHEN has_lines THEN coalesce(line_score, 0) ELSE c * ln(1 + n) END, 6) AS score FROM (
SELECT *, coalesce(CASE WHEN has_lines THEN line_confidence ELSE block_confidence END, 0)::DOUBLE AS c, greatest(0, CASE WHEN has_lines THEN line_chars ELSE letters END)::BIGINT AS n FROM {duck(_PROBES)})"""
)
def q_probe_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ro.probe_metrics(*map(F.col, ("has_lines", "line_confidence", "line_chars", "line_score", "block_confidence", "letters")))
    got = made(spark, sf_dir, _PROBES).select("event_id", m.alias("m"))
    return got.select("event_id", F.round("m.confidence", 6).alias("confidence"), "m.characters", F.round("m.score", 6).alias("score"))


_IMAGES = "SELECT l_orderkey AS page, l_partkey AS image, l_quantity * 25e0 AS w, (l_suppkey % 100) * 14e0 AS h, 1000 AS page_width, 1400 AS page_height FROM {lineitem}"
_NATIVE = "SELECT o_orderkey AS page, o_custkey % 60 AS solid FROM {orders}"


@query(
    f"""WITH i AS (SELECT page, count(DISTINCT image) AS image_count, max(greatest(0, least(1, w * h / (page_width * page_height)))) AS share FROM {duck(_IMAGES)} GROUP BY page)
SELECT n.page, coalesce(image_count, 0) AS image_count, CASE WHEN coalesce(share, 0) >= 0.9 THEN CASE WHEN solid = 0 THEN 'full-page-raster-no-text-layer' WHEN solid <= 32 THEN 'full-page-raster-sparse-text-layer' ELSE 'full-page-raster-with-text-overlay' END
WHEN coalesce(share, 0) >= 0.2 THEN 'partial-raster-content' ELSE 'no-large-raster-layer' END AS media FROM {duck(_NATIVE)} n LEFT JOIN i ON i.page = n.page"""
)
def q_media_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as images on its page."""
    cover = ro.image_coverage(made(spark, sf_dir, _IMAGES))
    both = made(spark, sf_dir, _NATIVE).join(cover, "page", "left")
    return both.select("page", F.coalesce("image_count", F.lit(0)).cast("long").alias("image_count"), ro.media_class(F.col("max_coverage"), F.col("solid")).alias("media"))


_MEASURES = "SELECT user_id AS document, event_id AS page, value / 100 AS pixel_similarity, (event_id % 17) / 17e0 AS foreground_iou, (event_id % 19) / 19e0 AS edge_f1, (event_id % 23) / 23e0 AS composite_score FROM {events}"


@query(
    f"""WITH m AS {duck(_MEASURES)}, r AS (SELECT document, count(*) AS n FROM m GROUP BY document), p AS (SELECT document, count(*) AS n FROM m WHERE page % 3 > 0 GROUP BY document)
SELECT m.document, any_value(r.n) AS reference_pages, any_value(p.n) AS predicted_pages, count(*) AS compared_pages, round(avg(pixel_similarity), 6) AS pixel_similarity, round(avg(foreground_iou), 6) AS foreground_iou, round(avg(edge_f1), 6) AS edge_f1,
round(any_value(least(r.n, p.n) / greatest(r.n, p.n)::DOUBLE), 6) AS page_count_score, round(avg(composite_score) * any_value(least(r.n, p.n) / greatest(r.n, p.n)::DOUBLE), 6) AS composite_score
FROM m JOIN r USING (document) JOIN p USING (document) WHERE m.page % 3 > 0 GROUP BY m.document"""
)
def q_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as pages of a user's document; the prediction lacks a third of them."""
    m = made(spark, sf_dir, _MEASURES)
    there = m.where("page % 3 > 0")
    got = ro.fidelity(m.select("document", "page"), there.select("document", "page"), there)
    return got.withColumns({c: F.round(c, 6) for c in ("pixel_similarity", "foreground_iou", "edge_f1", "page_count_score", "composite_score")})


_LINES = "SELECT conv_id AS page, text, CASE WHEN turn % 5 = 0 THEN 20 ELSE (turn * 37) % 50 END AS w, CASE WHEN turn % 7 = 0 THEN 0 ELSE 20 END AS h FROM {conversations}"


@query(
    f"""WITH l AS (SELECT *, len(regexp_replace(coalesce(text, ''), '\\s', '', 'g')) AS n FROM {duck(_LINES)}), a AS (SELECT *, CASE WHEN n >= 2 AND least(w, h) > 0 AND w <> h THEN CASE WHEN w > h THEN 'h' ELSE 'v' END END AS axis FROM l),
g AS (SELECT page, count(*) FILTER (WHERE axis = 'h') AS horizontal_lines, count(*) FILTER (WHERE axis = 'v') AS vertical_lines, coalesce(sum(n) FILTER (WHERE axis = 'h'), 0)::BIGINT AS horizontal_characters, coalesce(sum(n) FILTER (WHERE axis = 'v'), 0)::BIGINT AS vertical_characters,
count(*) FILTER (WHERE axis IS NULL) AS ignored_lines FROM a GROUP BY page) SELECT *, vertical_lines >= 2 AND vertical_characters > horizontal_characters AS sideways FROM g"""
)
def q_line_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as lines of a page."""
    return ori.line_geometry(made(spark, sf_dir, _LINES))


_SKIPS = "SELECT event_id, value / 100 AS confidence, event_id % 300 AS chars, (event_id % 10) / 10e0 AS share, event_id % 6 = 0 AS sideways FROM {events}"


@query(f"SELECT event_id, CASE WHEN sideways THEN NULL WHEN confidence >= 0.65 THEN 'high-confidence' WHEN confidence >= 0.45 AND chars >= 200 AND share >= 0.75 THEN 'lao-dominant-baseline' END AS reason FROM {duck(_SKIPS)}")
def q_skip_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, _SKIPS).select("event_id", ori.skip_reason(F.col("confidence"), F.col("chars"), F.col("share"), F.col("sideways")).alias("reason"))


_DOCS = "SELECT o_orderkey AS document, CAST(o_custkey % 6 AS INT) AS page_count, CASE WHEN o_orderkey % 5 = 0 THEN false WHEN o_orderkey % 5 = 1 THEN NULL ELSE true END AS requested FROM {orders}"
_RECORDS = """SELECT l_orderkey AS document, CAST(l_partkey % 6 AS INT) AS page, CAST(l_suppkey % 5 * 90 AS INT) AS degrees, l_linenumber % 4 AS candidates, l_partkey % 3 AS horizontal_lines, l_partkey % 5 AS vertical_lines,
l_partkey % 3 * 7 AS horizontal_characters, l_partkey % 5 * (l_suppkey % 4) AS vertical_characters, l_suppkey % 2 AS ignored_lines FROM {lineitem}"""


@query(
    f"""WITH d AS {duck(_DOCS)}, r AS {duck(_RECORDS)}, a AS (SELECT document, page, count(*) AS n, bool_or(CASE WHEN degrees IN (0, 90, 180, 270) AND candidates = 1 AND horizontal_lines + vertical_lines > 0 AND horizontal_characters >= 2 * horizontal_lines AND vertical_characters >= 2 * vertical_lines
AND (horizontal_lines > 0 OR horizontal_characters = 0) AND (vertical_lines > 0 OR vertical_characters = 0) THEN vertical_lines >= 2 AND vertical_characters > horizontal_characters END) AS sideways FROM r GROUP BY document, page),
p AS (SELECT d.document, page_count, requested, t.page FROM d, range(1, 6) t(page) WHERE t.page <= page_count), s AS (SELECT p.*, CASE WHEN n = 1 AND requested THEN sideways END AS state FROM p LEFT JOIN a ON a.document = p.document AND a.page = p.page),
g AS (SELECT d.document, d.page_count, d.requested, coalesce(string_agg(page, ',' ORDER BY page) FILTER (WHERE state), '') AS review_pages, coalesce(string_agg(page, ',' ORDER BY page) FILTER (WHERE page IS NOT NULL AND state IS NULL), '') AS unassessed_pages FROM d LEFT JOIN s ON s.document = d.document GROUP BY ALL)
SELECT document, review_pages, unassessed_pages, CASE WHEN requested IS NULL THEN 'not-assessed' WHEN NOT requested THEN 'not-requested' WHEN review_pages <> '' THEN 'review-required' WHEN unassessed_pages <> '' OR page_count = 0 THEN 'incomplete' ELSE 'no-sideways-evidence' END AS status FROM g"""
)
def q_orientation_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as records of its pages; the line number says how many candidates have the chosen turn."""
    geometry = F.struct(F.lit(ro.GEOMETRY_VERSION).alias("version"), *ro.GEOMETRY_COUNTS)
    rows = made(spark, sf_dir, _RECORDS).withColumn("geometry", geometry)
    candidates = F.when(F.col("candidates") > 0, F.array_repeat(F.struct("degrees", "geometry"), F.col("candidates").cast("int"))).otherwise(F.array(F.struct((F.col("degrees") + 1).alias("degrees"), "geometry")))
    got = ro.orientation_review(made(spark, sf_dir, _DOCS), rows.select("document", "page", "degrees", candidates.alias("candidates")))
    return got.select("document", F.array_join("review_pages", ",").alias("review_pages"), F.array_join("unassessed_pages", ",").alias("unassessed_pages"), "status")


_PLAIN = _CODED.replace("a.text AS reference, b.text AS hypothesis", f"{_FLAT.format('a.text')} AS reference, {_FLAT.format('b.text')} AS hypothesis, length(a.text) AS raw, length(b.text) AS raw_h, b.text = '' AS void")


@query(
    f"""WITH {_PLAIN}, t AS (SELECT count(*) AS samples, sum(char_edits)::BIGINT AS character_edits, sum(n_chars)::BIGINT AS characters, count(*) FILTER (WHERE void) AS empty_predictions, sum(raw_h)::BIGINT AS predicted_characters, sum(raw)::BIGINT AS reference_characters,
sum(turn % 5)::BIGINT AS blank_timesteps, sum(10 + turn % 7)::BIGINT AS valid_timesteps FROM edits)
SELECT *, round(character_edits / characters, 6) AS cer, round(empty_predictions / samples, 6) AS empty_ratio, round(predicted_characters / reference_characters, 6) AS length_ratio, round(blank_timesteps / valid_timesteps, 6) AS blank_ratio FROM t"""
)
def q_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and the next ones as lines and what was read; steps are made from the turn's number."""
    rows = turn_pairs(spark, sf_dir).withColumns({"steps": 10 + F.col("turn") % 7, "blank_steps": F.col("turn") % 5})
    got = ro.telemetry(rows)
    return got.withColumns({c: F.round(c, 6) for c in ("cer", "empty_ratio", "length_ratio", "blank_ratio")})


_LOGITS = "SELECT (value - 50) / 10 AS logit, CAST(event_id % 2 AS INT) AS label FROM {events}"


@query(f"SELECT round(avg(((logit >= 0)::INT = label)::INT), 6) AS accuracy, round(avg(greatest(logit, 0) - logit * label + ln(1 + exp(-abs(logit)))), 6) AS loss, count(*) AS pairs FROM {duck(_LOGITS)} WHERE logit IS NOT NULL")
def q_pair_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ro.pair_figures(made(spark, sf_dir, _LOGITS).where("logit is not null"))
    return got.select(F.round("accuracy", 6).alias("accuracy"), F.round("loss", 6).alias("loss"), "pairs")


_CERS = "SELECT event_id, CASE WHEN event_id % 6 > 0 THEN value / 100 END AS uncalibrated_confidence, CASE WHEN event_id % 5 > 0 THEN value / 70 - 0.1e0 END AS cer FROM {events}"


@query(f"SELECT count(*) AS points, round(avg(uncalibrated_confidence), 6) AS confidence, round(avg(greatest(0, least(1, 1 - cer))), 6) AS accuracy FROM {duck(_CERS)} WHERE uncalibrated_confidence IS NOT NULL AND cer IS NOT NULL")
def q_calibration_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ro.calibration_points(made(spark, sf_dir, _CERS))
    return got.agg(F.count("*").alias("points"), F.round(F.avg("confidence"), 6).alias("confidence"), F.round(F.avg("accuracy"), 6).alias("accuracy"))


_FITS = "SELECT event_id AS ord, event_type || event_id AS id, event_id % 40 AS required, 48 AS height, event_id % 500 AS width, event_id % 500 > 400 AS capped FROM {events}"


@query(
    f"""WITH f AS (SELECT *, greatest(1, floor(width / 4))::BIGINT AS available FROM {duck(_FITS)}) SELECT count(*) AS samples, count(*) FILTER (WHERE available < required) AS failures, min(available - required) AS min_margin, max(required) AS max_required, max(available) AS max_available,
count(*) FILTER (WHERE capped) AS width_capped, min(height) AS min_height, max(height) AS max_height, min(width) AS min_width, max(width) AS max_width, arg_min(id, ord) FILTER (WHERE available < required) AS first_failure FROM f"""
)
def q_ctc_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ro.capacity(made(spark, sf_dir, _FITS))


_REPORTS = """SELECT CASE doc_id % 5 WHEN 0 THEN 'docx' WHEN 1 THEN 'layout' WHEN 2 THEN 'ocr' WHEN 3 THEN 'recognizer' ELSE 'other' END AS kind, 'r' || doc_id AS file,
'{"schema_version": "1", "overall": {"samples": ' || n_chars || ', "cer": 0.' || doc_id % 90 || ', "wer": "x"}, "metrics": {"block_f1": 0.5, "mean_iou": ' || doc_id % 3 || ', "composite_score": 0.' || doc_id % 7 || '}}' AS content FROM {documents}"""
_METRICS = "VALUES (2, 'docx', 'composite_score'), (2, 'docx', 'pixel_similarity'), (2, 'docx', 'foreground_iou'), (2, 'docx', 'edge_f1'), (2, 'docx', 'page_count_score'), (1, 'layout', 'block_f1'), (1, 'layout', 'mean_iou'), (1, 'layout', 'block_type_accuracy'), (1, 'layout', 'reading_order_accuracy'), (1, 'layout', 'table_cell_f1'), (0, 'ocr', 'samples'), (0, 'ocr', 'cer'), (0, 'ocr', 'wer'), (0, 'recognizer', 'samples'), (0, 'recognizer', 'cer'), (0, 'recognizer', 'wer')"


def _report_sql() -> str:
    part = "json_extract(content, CASE WHEN r.kind IN ('ocr', 'recognizer') THEN '$.overall.' ELSE '$.metrics.' END || metric)"
    place = "CASE r.kind WHEN 'ocr' THEN 0 WHEN 'recognizer' THEN 1 WHEN 'layout' THEN 2 WHEN 'docx' THEN 3 END"
    return f"""WITH r AS {_bare(_REPORTS)}, m AS (SELECT * FROM ({_METRICS}) AS v(k, kind, metric)) SELECT {place} AS place, r.kind, file, sha256(content) AS sha256, '1' AS schema_version, metric,
CASE WHEN json_type({part}) IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN {part}::DOUBLE END AS value FROM r LEFT JOIN m ON m.kind = r.kind"""


def _bare(sql: str) -> str:
    return "(" + sql.replace("{documents}", "documents") + ")"


@query(_report_sql())
def q_report_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports made of documents' numbers, bundled with hashes in the fixed order of kinds."""
    sql = _REPORTS.replace("{documents}", "_bundle_documents")
    table(spark, sf_dir, "documents").createOrReplaceTempView("_bundle_documents")
    return ro.bundle(spark.sql(sql))


_FOUND = "SELECT page_id % 97 AS page, url AS name FROM {pages}"


@query(
    f"""WITH f AS {duck(_FOUND)}, p AS (SELECT page_id AS page FROM pages WHERE page_id < 200), n AS (SELECT page, count(*) AS n, min(name) AS name FROM f GROUP BY page)
SELECT p.page, CASE WHEN coalesce(n, 0) > 1 THEN 'duplicate' WHEN n = 1 THEN 'complete' ELSE 'pending' END AS state, CASE WHEN n = 1 THEN name END AS capture_file FROM p LEFT JOIN n ON n.page = p.page"""
)
def q_session_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").where("page_id < 200").select(F.col("page_id").alias("page"))
    return ro.session_progress(pages, made(spark, sf_dir, _FOUND))


_PACKS = "SELECT 's' AS suite, CASE doc_id % 7 WHEN 0 THEN 'plain' WHEN 1 THEN 'two-column' WHEN 2 THEN 'ruled-table' WHEN 3 THEN 'borderless-table' WHEN 4 THEN 'receipt' WHEN 5 THEN 'form' ELSE 'new' END AS template, doc_id AS page, source AS image, lang AS ground_truth, text FROM {documents}"
_SUBSETS = {"plain": "clean-print", "two-column": "multi-column", "ruled-table": "simple-table", "borderless-table": "complex-table", "receipt": "receipt", "form": "form"}
_OF_TEMPLATE = "CASE template " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SUBSETS.items()) + " ELSE 'other' END"


def _suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    packs = made(spark, sf_dir, _PACKS).withColumns({"sha256": F.sha2("text", 256), "tags": vl.template_tags(F.col("template"), F.coalesce("text", F.lit("")))})
    return ro.suite_samples(packs, _SUBSETS)


@query(f"SELECT page AS id, 'test' AS split, {_OF_TEMPLATE} AS subset, image AS source, sha256(text) AS sha256 FROM {duck(_PACKS)}")
def q_suite_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of capture packs."""
    return _suite(spark, sf_dir).select("id", "split", "subset", "source", "sha256")


@query(f"SELECT template, count(*) AS n FROM {duck(_PACKS)} GROUP BY template")
def q_template_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ro.template_counts(_suite(spark, sf_dir))


_EXTRA = "CASE template WHEN 'plain' THEN ['layout:plain'] WHEN 'two-column' THEN ['layout:multi-column'] WHEN 'ruled-table' THEN ['content:table', 'layout:table', 'table:ruled'] WHEN 'borderless-table' THEN ['content:table', 'layout:table', 'table:borderless'] WHEN 'receipt' THEN ['document:receipt', 'layout:receipt'] WHEN 'form' THEN ['document:form', 'layout:form'] ELSE [] END"
_LANGUAGE = r"CASE WHEN regexp_matches(t, '[\x{0E80}-\x{0EFF}]') AND regexp_matches(t, '[A-Za-z]') THEN 'language:mixed' WHEN regexp_matches(t, '[\x{0E80}-\x{0EFF}]') THEN 'language:lao' WHEN regexp_matches(t, '[A-Za-z]') THEN 'language:latin' ELSE 'language:other' END"


@query(f"SELECT id, array_to_string(list_sort(list_concat(['source:capture-pack', 'page-id:qr-v1', 'template:' || template, {_LANGUAGE}, 'qa:digital-capture-suite', 'source:digital-capture-suite'], {_EXTRA})), ',') AS tags FROM (SELECT page AS id, template, coalesce(text, '') AS t FROM {duck(_PACKS)})")
def q_template_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suite(spark, sf_dir).select("id", F.array_join(F.array_sort("tags"), ",").alias("tags"))
