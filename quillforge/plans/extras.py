"""Queries over single rules: spatial lookups, value-like texts, tags, reviews, calibration error, segmentation, vocabulary coding, URLs, SQL functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillforge.functions import geometry as gm
from quillforge.functions import sql
from quillforge.functions import text as tx
from quillforge.functions import values as vl
from quillforge.operators import corpus as cp
from quillforge.operators import datasets as dt
from quillforge.operators import layout as lo
from quillforge.operators import metrics as mt
from quillforge.operators import spatial as sp
from quillforge.plans.corpus import _SPLIT
from quillforge.plans.evaluation import _BINS, _SAMPLES, _points, samples
from quillforge.plans.inputs import duck, made
from quillforge.plans.layout import _BOX, boxes
from quillforge.plans.registry import query
from quillforge.tables import table

_AT = "SELECT event_id, value AS v, CAST(user_id % 30 AS DOUBLE) AS a, CAST(user_id % 30 + 25 AS DOUBLE) AS b, CAST(user_id % 30 + 60 AS DOUBLE) AS c FROM {events} WHERE value IS NOT NULL"


@query(
    f"""SELECT event_id, CASE WHEN v BETWEEN a AND b THEN 0 WHEN v BETWEEN b AND c THEN 1 END AS cell, CASE WHEN abs(v - a) <= abs(v - b) AND abs(v - a) <= abs(v - c) THEN 0 WHEN abs(v - b) <= abs(v - c) THEN 1 ELSE 2 END AS anchor,
CASE WHEN a BETWEEN v - 30 AND v + 10 THEN 0 WHEN b BETWEEN v - 30 AND v + 10 THEN 1 WHEN c BETWEEN v - 30 AND v + 10 THEN 2 ELSE CASE WHEN abs(v - 10 - a) <= abs(v - 10 - b) AND abs(v - 10 - a) <= abs(v - 10 - c) THEN 0 WHEN abs(v - 10 - b) <= abs(v - 10 - c) THEN 1 ELSE 2 END END AS first,
1 + CASE WHEN NOT v >= a THEN 0 WHEN NOT v >= b THEN 1 WHEN NOT v >= c THEN 2 ELSE 3 END AS span FROM {duck(_AT)}"""
)
def q_axis_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values in cells, at their nearest anchor, over the anchors that an interval covers, and down rows."""
    at, v = F.array("a", "b", "c"), F.col("v")
    rows = made(spark, sf_dir, _AT)
    return rows.select("event_id", sp.cell_index(v, at).alias("cell"), sp.nearest_anchor(v, at).alias("anchor"), sp.covered_anchors(v - 30, v + 10, at)["first"].alias("first"), sp.row_span(v, at).cast("int").alias("span"))


_TOKENS = "SELECT conv_id AS page, 1 AS block, CAST(floor(turn / 4) AS INT) AS par, CAST(floor(turn / 2) AS INT) AS line, turn AS ord, CASE WHEN turn % 7 = 3 THEN ' ' ELSE role || turn END AS text, CASE WHEN turn % 5 = 0 THEN -1e0 ELSE turn / 10e0 END AS confidence, turn * 10 AS x, turn % 3 AS y, 20 AS w, 10 AS h FROM {conversations}"


@query(f"SELECT page, par, line, string_agg(text, ' ' ORDER BY ord) AS text, round(avg(CASE WHEN confidence >= 0 THEN confidence END), 6) AS confidence, min(x) AS x, max(x + w) - min(x) AS w FROM {duck(_TOKENS)} WHERE trim(text) <> '' GROUP BY page, block, par, line")
def q_token_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.token_lines(made(spark, sf_dir, _TOKENS)).select("page", "par", "line", "text", F.round("confidence", 6).alias("confidence"), "x", "w")


_AMOUNTS = "SELECT event_id, CASE event_id % 6 WHEN 0 THEN '₭ ' || user_id WHEN 1 THEN user_id || ' usd' WHEN 2 THEN '1,' || user_id || '.50 (%)' WHEN 3 THEN event_type WHEN 4 THEN '--' ELSE user_id || ' of ' || event_id END AS t FROM {events}"


@query(rf"SELECT event_id, regexp_matches(t, '[$€£¥₭]') OR regexp_matches(t, '(?i)\b(USD|LAK|THB|EUR)\b') OR (regexp_full_match(trim(t), '[\d\s.,:/()%+\-]+') AND regexp_matches(t, '\d')) AS amount FROM {duck(_AMOUNTS)}")
def q_value_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, _AMOUNTS).select("event_id", tx.value_like(F.col("t")).alias("amount"))


_TAGS = "SELECT doc_id, ' ' || upper(lang) AS a, lang || ' ' AS b, CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE source END AS c FROM {documents}"


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform([a, b, c], lambda t: lower(trim(t))), lambda t: t <> ''))), ',') AS tags FROM {duck(_TAGS)}")
def q_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, _TAGS).select("doc_id", F.array_join(tx.tags(F.array("a", "b", "c")), ",").alias("tags"))


_DECISIONS = "SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'rejected' ELSE 'approved' END AS status FROM {labels}"
_WRONG = "SELECT doc_id * 2 AS id, CASE WHEN doc_id % 9 = 0 THEN 'maybe' ELSE 'approved' END AS status FROM {labels} UNION ALL SELECT doc_id, 'rejected' FROM {labels} WHERE doc_id % 10 = 0"


@query(f"WITH {_SAMPLES} SELECT s.id, coalesce(d.status, s.status) AS status FROM s LEFT JOIN {duck(_DECISIONS)} d ON d.id = s.id")
def q_apply_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dt.apply_reviews(samples(spark, sf_dir), made(spark, sf_dir, _DECISIONS))[0].select("id", "status")


@query(
    f"""WITH d AS {duck(_WRONG)}, p AS (SELECT id, count(*) AS n FROM d GROUP BY id) SELECT id, 'decided twice' AS problem FROM p WHERE n > 1 UNION ALL SELECT id, 'unknown status' FROM d WHERE status NOT IN ('approved', 'rejected')
UNION ALL SELECT id, 'unknown sample' FROM p WHERE id NOT IN (SELECT doc_id FROM documents)"""
)
def q_review_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of which some are doubled, some say neither and some are on no sample."""
    return dt.apply_reviews(samples(spark, sf_dir), made(spark, sf_dir, _WRONG))[1]


@query(f"SELECT count(*) AS decision_count, count(*) FILTER (WHERE status = 'approved') AS approved_count, count(*) FILTER (WHERE status = 'rejected') AS rejected_count FROM {duck(_DECISIONS)}")
def q_review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dt.review_summary(made(spark, sf_dir, _DECISIONS))


@query(
    f"""{_BINS}, u AS (SELECT DISTINCT confidence AS v FROM pt), i AS (SELECT v, arg_min(accuracy, bin) AS a FROM u JOIN b ON v BETWEEN low AND high GROUP BY v), j AS (SELECT v, arg_min(accuracy, struct_pack(d := abs(mean_confidence - v), k := bin)) AS a FROM u, b GROUP BY v)
SELECT count(*) AS points, round(avg(abs(confidence - pt.accuracy)), 6) AS raw_mae, round(avg(abs(coalesce(i.a, j.a) - pt.accuracy)), 6) AS calibrated_mae FROM pt JOIN j ON j.v = confidence LEFT JOIN i ON i.v = confidence WHERE pt.accuracy IS NOT NULL"""
)
def q_calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    got = mt.calibration_error(points.where("accuracy is not null"), mt.calibration_bins(points))
    return got.select("points", F.round("raw_mae", 6).alias("raw_mae"), F.round("calibrated_mae", 6).alias("calibrated_mae"))


_CLASSES = "SELECT CAST(l_partkey % 5 AS INT) AS target, CAST(CASE WHEN l_suppkey % 3 = 0 THEN l_partkey % 5 ELSE l_suppkey % 4 END AS INT) AS predicted FROM {lineitem}"


@query(
    f"""WITH p AS {duck(_CLASSES)}, c AS (SELECT k, count(*) FILTER (WHERE target = k AND predicted = k) AS d, count(*) FILTER (WHERE target = k OR predicted = k) AS u FROM p, range(5) r(k) GROUP BY k)
SELECT (SELECT round(avg((target = predicted)::INT), 6) FROM p) AS pixel_accuracy, round(avg(d / nullif(u, 0)), 6) AS mean_iou, round(avg(d / nullif(u, 0)) FILTER (WHERE k > 0), 6) AS foreground_mean_iou FROM c"""
)
def q_segmentation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as pixels, made-up classes on both sides."""
    got = mt.segmentation_summary(mt.confusion(made(spark, sf_dir, _CLASSES), "target", "predicted"))
    return got.select(*(F.round(c, 6).alias(c) for c in got.columns))


_VOCAB = "SELECT DISTINCT unnest(string_split(nfc_normalize(text), '')) AS char FROM benchmark"


def _vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.vocabulary(table(spark, sf_dir, "benchmark").select(tx.nfc(F.col("text")).alias("text")), "text")


@query(
    f"""WITH v AS (SELECT char, row_number() OVER (ORDER BY encode(char)) AS id FROM ({_VOCAB}) WHERE char NOT IN ('', chr(10), chr(13))), t AS (SELECT conv_id, turn, string_split(role, '') AS c FROM conversations),
e AS (SELECT conv_id, turn, unnest(c) AS char, unnest(range(len(c))) AS i FROM t) SELECT conv_id * 100 + turn AS k, string_agg(id, ',' ORDER BY i) AS ids FROM e JOIN v ON v.char = e.char GROUP BY conv_id, turn HAVING count(*) = (SELECT any_value(len(c)) FROM t x WHERE x.conv_id = e.conv_id AND x.turn = e.turn)"""
)
def q_encoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roles of turns in the vocabulary of the benchmark."""
    texts = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("k"), F.col("role").alias("t"))
    good, _ = cp.encoded(texts, "k", "t", _vocab(spark, sf_dir))
    return good.select("k", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


@query("SELECT conv_id * 100 + turn AS k, trim(role || ' ' || turn) AS text FROM conversations")
def q_decoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short texts back from their ids, every id given twice and with blanks between."""
    vocab = _vocab(spark, sf_dir)
    texts = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("k"), F.concat_ws(" ", "role", "turn").alias("t"))
    every = vocab.select("char").unionByName(cp.characters(texts, "t").select("char")).distinct()
    own = cp.vocabulary(every.withColumnRenamed("char", "one"), "one")
    good, _ = cp.encoded(texts, "k", "t", own)
    spread = good.select("k", F.flatten(F.transform("ids", lambda i: F.array(i, i, F.lit(0).cast("long")))).alias("ids"))
    return cp.decoded(spread, "k", own)


_URLS = "SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'http://h.example/' WHEN 1 THEN 'https://u:p@h.example/x' WHEN 2 THEN 'https://h.example:8443/' WHEN 3 THEN 'https://10.0.0.' || page_id % 200 || '/' WHEN 4 THEN 'https://192.168.1.1:443/a' WHEN 5 THEN 'https://172.' || page_id % 40 || '.0.1/' WHEN 6 THEN 'https:///x' ELSE 'https://h' || page_id || '.example/p?q' END AS url FROM {pages}"


@query(
    f"""SELECT page_id, CASE WHEN url NOT LIKE 'https://%' THEN 'not HTTPS' WHEN url LIKE 'https:///%' THEN 'no host' WHEN url LIKE '%@%' THEN 'user info' WHEN url LIKE '%:8443/%' THEN 'another port'
WHEN url LIKE 'https://10.%' OR url LIKE 'https://192.168.%' OR regexp_matches(url, '^https://172[.](1[6-9]|2[0-9]|3[01])[.]') THEN 'not a public address' END AS problem FROM {duck(_URLS)}"""
)
def q_url_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, _URLS).select("page_id", vl.url_problem(F.col("url")).alias("problem"))


_TURNED = f"WITH t AS ({_BOX.format(0)})"


@query(
    f"""{_TURNED} SELECT page, ord, CASE ord % 4 WHEN 0 THEN x WHEN 1 THEN 1400 - y - h WHEN 2 THEN 1000 - x - w ELSE y END AS x, CASE ord % 4 WHEN 0 THEN y WHEN 1 THEN x WHEN 2 THEN 1400 - y - h ELSE 1000 - x - w END AS y,
round(CASE WHEN ord % 2 = 0 THEN w / 1000.0 ELSE h / 1400.0 END, 6)::DOUBLE AS width_ratio FROM t"""
)
def q_turned_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes after a turn of their page by the line number's quarter turns."""
    box, share = gm.turned_assets(gm.Box.of(), F.col("ord") % 4 * 90, F.lit(1000), F.lit(1400))
    return boxes(spark, sf_dir).select("page", "ord", box.x.alias("x"), box.y.alias("y"), F.round(share, 6).alias("width_ratio"))


@query("SELECT event_id, greatest(1, least(500, round_even((event_id % 977 + 1) * 48 / (user_id % 90 + 10), 0)))::INT AS width FROM events")
def q_resize_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", gm.resize_plan(F.col("event_id") % 977 + 1, F.col("user_id") % 90 + 10, 48, 500).alias("width"))


@query("SELECT r.page, r.k AS place, r.ord AS ref_page, p.ord AS pred_page FROM (SELECT o_custkey AS page, o_orderkey AS ord, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) r JOIN (SELECT o_custkey AS page, o_orderkey AS ord, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_orderkey % 3 > 0) p ON p.page = r.page AND p.k = r.k")
def q_paired_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as pages of a document; the prediction lacks a third of them."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document"), F.col("o_orderkey").alias("page"))
    return lo.paired_pages(o, o.where("page % 3 > 0")).select(F.col("document").alias("page"), F.col("place").cast("long").alias("place"), "ref_page", "pred_page")


@query(f"SELECT doc_id, {_SPLIT.format('doc_id::VARCHAR')} AS split, length(text) AS n_chars, len(regexp_extract_all(text, '[^\\s]+')) AS n_words, sha256(unhex(lpad(hex(strlen(lang)), 16, '0') || hex(encode(lang)))) AS print FROM documents WHERE text IS NOT NULL")
def q_sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered functions from SQL text."""
    sql.register(spark)
    return spark.sql("SELECT doc_id, stable_split(CAST(doc_id AS STRING)) AS split, text_stats(text).n_chars AS n_chars, text_stats(text).n_words AS n_words, frame_fingerprint(array(lang, lang)) AS print FROM {documents} WHERE text IS NOT NULL", documents=table(spark, sf_dir, "documents"))
