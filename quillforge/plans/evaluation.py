"""Evaluation queries: edit metrics and gates over conversations, dataset reports over documents and labels, calibration over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillforge.functions import hashing as hs
from quillforge.operators import datasets as dt
from quillforge.operators import metrics as mt
from quillforge.plans.corpus import _SPLIT
from quillforge.plans.registry import query
from quillforge.tables import table

#: DuckDB's levenshtein counts bytes, so each pair's characters are renamed to the first ASCII ones, of which a pair uses fewer than 127.
_CODED = """pairs AS (SELECT a.conv_id * 100 + a.turn AS sample_id, a.conv_id, a.turn, a.role AS subset, a.text AS reference, b.text AS hypothesis FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
letters AS (SELECT *, array_to_string(list_distinct(string_split(reference || hypothesis, '')), '') AS alphabet, (SELECT string_agg(chr(i::INT), '' ORDER BY i) FROM range(1, 128) t(i)) AS ascii FROM pairs),
edits AS (SELECT * EXCLUDE (alphabet, ascii), CASE WHEN length(alphabet) > 127 THEN error('too many characters') ELSE levenshtein(translate(reference, alphabet, left(ascii, length(alphabet))), translate(hypothesis, alphabet, left(ascii, length(alphabet)))) END AS char_edits,
length(reference) AS n_chars, length(hypothesis) AS h_chars, ['role-' || subset, CASE WHEN length(reference) > 100 THEN 'long' ELSE 'short' END] AS tags FROM letters)"""
_RATE = "CASE WHEN sum(n_chars) = 0 THEN (sum(h_chars) > 0)::INT::DOUBLE ELSE sum(char_edits) / sum(n_chars) END"
_REPORT = """SELECT 'overall' AS kind, 'all' AS name, * FROM edits {0} UNION ALL SELECT 'subset', subset, * FROM edits {0} UNION ALL SELECT 'tag', unnest(tags), * FROM edits {0}"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as reference and the next as hypothesis, whole and in every script."""
    return _tagged(turn_pairs(spark, sf_dir))


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    a = turns.select("conv_id", "turn", F.col("role").alias("subset"), F.col("text").alias("reference"))
    b = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hypothesis"))
    return a.join(b, ["conv_id", "turn"])


def _tagged(both: DataFrame) -> DataFrame:
    tags = F.array(F.concat(F.lit("role-"), F.col("subset")), F.when(F.char_length("reference") > 100, "long").otherwise("short"))
    return both.withColumn("sample_id", F.col("conv_id") * 100 + F.col("turn")).withColumn("tags", tags)


def _axes():
    pair = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    return F.concat(F.array(pair("overall", F.lit("all")), pair("subset", F.col("subset"))), F.transform("tags", lambda t: pair("tag", t)))


@query(f"WITH {_CODED} SELECT sample_id, char_edits, n_chars, round(CASE WHEN n_chars = 0 THEN (h_chars > 0)::INT::DOUBLE ELSE char_edits / n_chars END, 6) AS cer FROM edits")
def q_cer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cer(pairs(spark, sf_dir))


def _cer(both: DataFrame) -> DataFrame:
    e = mt.edit_columns(both)
    return e.select("sample_id", "char_edits", "n_chars", F.round(mt.tx.error_rate(F.col("char_edits"), F.col("n_chars"), F.col("h_chars")), 6).alias("cer"))


@query(f"WITH {_CODED} SELECT kind, name, count(*) AS samples, sum(char_edits)::BIGINT AS char_edits, sum(n_chars)::BIGINT AS n_chars, round({_RATE}, 6) AS cer FROM ({_REPORT.format('')}) GROUP BY kind, name")
def q_cer_by_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_axis(pairs(spark, sf_dir))


def _by_axis(both: DataFrame) -> DataFrame:
    got = mt.report(mt.edit_columns(both), _axes())
    return got.select("kind", "name", "samples", "char_edits", "n_chars", F.round("cer", 6).alias("cer"))


@query()
def q_wer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = mt.edit_columns(pairs(spark, sf_dir))
    return e.select("sample_id", "word_edits", "n_words", F.round(mt.tx.error_rate(F.col("word_edits"), F.col("n_words"), F.col("h_words")), 6).alias("wer"))


@query(
    f"""WITH {_CODED} SELECT subset, count(*) AS samples, count(*) FILTER (WHERE reference = hypothesis) AS exact, count(*) FILTER (WHERE hypothesis = '') AS empty,
round(count(*) FILTER (WHERE reference = hypothesis) / count(*), 6) AS exact_ratio FROM edits GROUP BY subset"""
)
def q_line_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_metrics(pairs(spark, sf_dir))


def _line_metrics(both: DataFrame) -> DataFrame:
    exact = F.count_if(F.col("reference") == F.col("hypothesis"))
    got = both.groupBy("subset").agg(F.count("*").alias("samples"), exact.alias("exact"), F.count_if(F.col("hypothesis") == "").alias("empty"))
    return got.withColumn("exact_ratio", F.round(F.try_divide("exact", "samples"), 6))


_HALVES = f"""WITH {_CODED}, b AS (SELECT kind, name, {_RATE} AS cer FROM ({_REPORT.format('WHERE conv_id % 2 = 0')}) GROUP BY kind, name),
c AS (SELECT kind, name, {_RATE} AS cer FROM ({_REPORT.format('WHERE conv_id % 2 = 1')}) GROUP BY kind, name),
d AS (SELECT kind, name, b.cer AS baseline, c.cer AS candidate, c.cer - b.cer AS delta, c.cer - b.cer <= 0 AS passed FROM b JOIN c USING (kind, name))"""


def _halves(both: DataFrame) -> DataFrame:
    """Two reports, of the even and of the odd conversations, compared (the two sides of the comparison, not a sample)."""
    e = mt.edit_columns(both)
    return mt.compare(mt.report(e.where("conv_id % 2 = 0"), _axes()), mt.report(e.where("conv_id % 2 = 1"), _axes()), "cer")


@query(f"{_HALVES} SELECT kind, name, round(baseline, 6) AS baseline, round(candidate, 6) AS candidate, passed FROM d")
def q_compare_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slices(pairs(spark, sf_dir))


def _slices(both: DataFrame) -> DataFrame:
    return _halves(both).select("kind", "name", F.round("baseline", 6).alias("baseline"), F.round("candidate", 6).alias("candidate"), "passed")


@query(f"{_HALVES} SELECT *, improved AND no_regression AS accepted FROM (SELECT coalesce(max(CASE WHEN kind = 'overall' THEN -delta END) > 0, false) AS improved, bool_and(passed) AS no_regression, count(*) AS slices FROM d)")
def q_compare_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.gate(_halves(pairs(spark, sf_dir)))


@query(
    """WITH b AS (SELECT doc_id AS id, lang AS subset FROM documents), c AS (SELECT l.doc_id AS id, CASE WHEN l.toxic = 1 THEN 'toxic' ELSE d.lang END AS subset FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id)
SELECT id, change FROM (SELECT coalesce(b.id, c.id) AS id, CASE WHEN c.id IS NULL THEN 'missing' WHEN b.id IS NULL THEN 'extra' WHEN b.subset <> c.subset THEN 'relabelled' END AS change FROM b FULL JOIN c ON b.id = c.id) WHERE change IS NOT NULL"""
)
def q_compare_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against labels: a document without a label is missing, a toxic one has moved to a subset of its own."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("subset"))
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("toxic")).join(d, "id", "left")
    moved = labelled.select("id", F.when(F.col("toxic") == 1, "toxic").otherwise(F.col("subset")).alias("subset"))
    none = F.array().cast("array<string>").alias("tags")
    return mt.signature_changes(d.select("*", none), moved.select("*", none))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as dataset samples: source is the document, lang the subset, labels the reviews."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    tags = F.array_compact(F.array(F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("n_chars") > 2000, "long"), F.col("lang")))
    rows = d.join(lab, "doc_id", "left")
    return rows.select(F.col("doc_id").alias("id"), F.col("source").alias("document_id"), hs.stable_split(F.col("doc_id").cast("string")).alias("split"), F.col("lang").alias("subset"), tags.alias("tags"), dt.review_status(F.col("quality")).alias("status"), F.sha2("text", 256).alias("sha256"), F.concat(F.col("source"), F.lit("/"), F.col("doc_id")).alias("path"), "text")


_SAMPLES = f"""s AS (SELECT d.doc_id AS id, source AS document_id, {_SPLIT.format('d.doc_id::VARCHAR')} AS split, lang AS subset, text, sha256(text) AS sha256,
list_filter([CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN n_chars > 2000 THEN 'long' END, lang], lambda x: x IS NOT NULL) AS tags,
CASE WHEN quality = 1 THEN 'approved' WHEN quality = 0 THEN 'rejected' ELSE 'unreviewed' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


#: Samples of which some break each rule: paths, hashes and tags are spoilt by the document's number.
_SPOILT = f"""{_SAMPLES}, q AS (SELECT * EXCLUDE (sha256, tags), CASE id % 9 WHEN 0 THEN '/' || id WHEN 1 THEN 'a/../' || id WHEN 2 THEN 'C:' || id WHEN 3 THEN '' ELSE document_id || '/' || id END AS path,
CASE WHEN id % 10 = 0 THEN left(sha256, 63) WHEN id % 10 = 1 THEN left(sha256, 63) || 'g' ELSE sha256 END AS sha256, CASE WHEN id % 8 = 0 THEN list_append(tags, 'Bad Tag') ELSE tags END AS tags FROM s)"""


@query(
    f"""WITH {_SPOILT} SELECT rule, count(*) AS n FROM (SELECT 'empty-text' AS rule FROM q WHERE trim(coalesce(text, '')) = ''
UNION ALL SELECT 'unsafe-path' FROM q WHERE path = '' OR path LIKE '/%' OR path LIKE 'C:%' OR list_contains(string_split(path, '/'), '..')
UNION ALL SELECT 'bad-hash' FROM q WHERE NOT regexp_full_match(lower(sha256), '[0-9a-f]{{64}}')
UNION ALL SELECT 'bad-tag' FROM q WHERE len(list_filter(tags, lambda t: NOT regexp_full_match(t, '[a-z0-9][a-z0-9-]*'))) > 0
UNION ALL SELECT 'duplicate-id' FROM q GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'split-leakage' FROM q GROUP BY document_id HAVING count(DISTINCT split) > 1
UNION ALL SELECT 'duplicate-hash' FROM q WHERE sha256 IS NOT NULL GROUP BY sha256 HAVING count(DISTINCT id) > 1) GROUP BY rule"""
)
def q_manifest_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir)
    k = lambda n: F.col("id") % n
    path = F.when(k(9) == 0, F.concat(F.lit("/"), "id")).when(k(9) == 1, F.concat(F.lit("a/../"), "id")).when(k(9) == 2, F.concat(F.lit("C:"), "id")).when(k(9) == 3, "").otherwise(F.col("path"))
    head = F.left("sha256", F.lit(63))
    digest = F.when(k(10) == 0, head).when(k(10) == 1, F.concat(head, F.lit("g"))).otherwise(F.col("sha256"))
    tags = F.when(k(8) == 0, F.array_append("tags", "Bad Tag")).otherwise(F.col("tags"))
    spoilt = rows.withColumns({"path": path, "sha256": digest, "tags": tags})
    return dt.violations(spoilt).groupBy("rule").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_SAMPLES} SELECT axis, value, count(*) AS n FROM (SELECT 'split' AS axis, split AS value FROM s UNION ALL SELECT 'subset', subset FROM s
UNION ALL SELECT 'status', status FROM s UNION ALL SELECT 'tag', unnest(tags) FROM s) GROUP BY axis, value"""
)
def q_dataset_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dt.axis_counts(samples(spark, sf_dir))


def _with_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples whose text says how it is licensed, with the language of their subset; long ones have a layout."""
    rows = samples(spark, sf_dir)
    license_ = F.when(F.contains(F.lower("text"), F.lit("licen")), "stated").otherwise("none")
    return rows.withColumns({"license": F.coalesce(license_, F.lit("none")), "language": F.col("subset"), "has_layout": F.array_contains("tags", "long")})


@query(
    f"""WITH {_SAMPLES} SELECT axis, value, count(*) AS n FROM (SELECT 'split' AS axis, split AS value FROM s UNION ALL SELECT 'subset', subset FROM s UNION ALL SELECT 'status', status FROM s UNION ALL SELECT 'language', subset FROM s
UNION ALL SELECT 'license', CASE WHEN contains(lower(text), 'licen') THEN 'stated' ELSE 'none' END FROM s UNION ALL SELECT 'tag', unnest(tags) FROM s) GROUP BY axis, value"""
)
def q_dataset_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's counts by licence and language too."""
    return dt.axis_counts(_with_layout(spark, sf_dir))


@query(
    f"""WITH {_SAMPLES}, d AS (SELECT document_id, count(*) AS captures, arg_min(split, id) AS split, count(*) FILTER (WHERE list_contains(tags, 'long')) AS l FROM s GROUP BY document_id)
SELECT (SELECT count(*) FROM s) AS samples, count(*) AS documents, (SELECT count(*) FROM s WHERE status = 'approved') AS approved, (SELECT count(*) FROM s WHERE status = 'rejected') AS rejected, (SELECT count(*) FROM s WHERE status = 'unreviewed') AS unreviewed,
round((SELECT count(*) FROM s WHERE status = 'approved') / (SELECT count(*) FROM s)::DOUBLE, 6) AS approved_ratio, sum(l)::BIGINT AS layout_samples, count(*) FILTER (WHERE l > 0) AS layout_documents, round(sum(l) / (SELECT count(*) FROM s)::DOUBLE, 6) AS layout_ratio,
min(captures) AS captures_min, max(captures) AS captures_max, round(avg(captures), 6) AS captures_mean, count(*) FILTER (WHERE split = 'train') AS train_documents, count(*) FILTER (WHERE split = 'development') AS development_documents, count(*) FILTER (WHERE split = 'test') AS test_documents,
(SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT unnest(['de', 'en', 'lo', 'th']) AS v) WHERE v NOT IN (SELECT subset FROM s WHERE subset IS NOT NULL)) AS missing_subsets FROM d"""
)
def q_dataset_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = dt.report_totals(_with_layout(spark, sf_dir), ["de", "en", "lo", "th"])
    ratios = {c: F.round(c, 6) for c in ("approved_ratio", "layout_ratio", "captures_mean")}
    return got.withColumns({**ratios, "missing_subsets": F.array_join("missing_subsets", ",")})


@query(f"WITH {_SAMPLES} SELECT subset, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'development') AS development, count(*) FILTER (WHERE split = 'test') AS test FROM s GROUP BY subset")
def q_coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dt.coverage_matrix(samples(spark, sf_dir), ["train", "development", "test"])


@query(
    f"""WITH {_SAMPLES}, d AS (SELECT document_id, status, unnest(list_filter([CASE WHEN subset IN ('en') OR list_has_any(tags, ['long']) THEN 'english-or-long' END,
CASE WHEN subset IN ('fr', 'es') THEN 'romance' END, CASE WHEN list_has_any(tags, ['toxic']) THEN 'toxic' END], lambda x: x IS NOT NULL)) AS dimension FROM s)
SELECT dimension, count(DISTINCT CASE WHEN status = 'approved' THEN document_id END) AS documents, count(*) FILTER (WHERE status <> 'approved') AS open,
CASE dimension WHEN 'english-or-long' THEN 15 WHEN 'romance' THEN 10 ELSE 5 END AS needed,
count(DISTINCT CASE WHEN status = 'approved' THEN document_id END) >= CASE dimension WHEN 'english-or-long' THEN 15 WHEN 'romance' THEN 10 ELSE 5 END AND count(*) FILTER (WHERE status <> 'approved') = 0 AS ready FROM d GROUP BY dimension"""
)
def q_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dt.readiness(samples(spark, sf_dir), {"english-or-long": (["en"], ["long"], 15), "romance": (["fr", "es"], ["-"], 10), "toxic": (["-"], ["toxic"], 5)})


@query(f"WITH {_SAMPLES} SELECT status, split, count(*) AS n FROM s WHERE status IN ('unreviewed', 'rejected') GROUP BY status, split")
def q_review_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples that need a review: none yet, or rejected."""
    return samples(spark, sf_dir).where(F.col("status").isin("unreviewed", "rejected")).groupBy("status", "split").agg(F.count("*").alias("n"))


@query(f"WITH {_SAMPLES} SELECT id, CASE WHEN toxic IS NOT NULL THEN CASE WHEN toxic = 1 THEN 'rejected' ELSE 'approved' END ELSE status END AS status FROM s LEFT JOIN (SELECT doc_id, toxic FROM labels) l ON id = l.doc_id")
def q_review_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "rejected").otherwise("approved").alias("status"))
    return dt.upsert_reviews(samples(spark, sf_dir), decisions).select("id", "status")


@query(f"WITH {_SAMPLES} SELECT status, subset, id, row_number() OVER (PARTITION BY status, subset ORDER BY id) AS place FROM s WHERE status <> 'approved'")
def q_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open samples in order of status, subset and id, numbered within each list."""
    w = mt.Window.partitionBy("status", "subset").orderBy("id")
    return samples(spark, sf_dir).where("status <> 'approved'").select("status", "subset", "id", F.row_number().over(w).cast("long").alias("place"))


_CAMPAIGN = """w AS (SELECT page, mode FROM (SELECT DISTINCT source AS page FROM documents), (SELECT unnest(['en', 'fr', 'de', 'es', 'lo']) AS mode)),
h AS (SELECT DISTINCT source AS page, lang AS mode FROM documents JOIN labels USING (doc_id) WHERE toxic = 1),
c AS (SELECT w.page, w.mode, h.page IS NOT NULL AS present FROM w LEFT JOIN h ON w.page = h.page AND w.mode = h.mode)"""


def _campaign(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("page"), F.col("lang").alias("mode"))
    have = d.join(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id")
    return dt.campaign(d.select("page").distinct(), ["en", "fr", "de", "es", "lo"], have)


@query(f"WITH {_CAMPAIGN} SELECT mode, count(*) AS wanted, count(*) FILTER (WHERE present) AS present, round(avg(present::INT), 6) AS coverage FROM c GROUP BY mode")
def q_campaign_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _campaign(spark, sf_dir).groupBy("mode")
    return got.agg(F.count("*").alias("wanted"), F.count_if("present").alias("present"), F.round(F.avg(F.col("present").cast("int")), 6).alias("coverage"))


@query(f"WITH {_CAMPAIGN} SELECT page, mode FROM c WHERE NOT present")
def q_campaign_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _campaign(spark, sf_dir).where(~F.col("present")).select("page", "mode")


_POINTS = "pt AS (SELECT event_id, (user_id % 97) / 97.0::DOUBLE AS confidence, least(1.0, greatest(0.0, value / 100.0::DOUBLE)) AS accuracy FROM events)"
_BINS = f"""WITH {_POINTS}, r AS (SELECT *, row_number() OVER (ORDER BY confidence, accuracy) - 1 AS k, count(*) OVER () AS n FROM pt),
b AS (SELECT (k // ceil(n / least(10, n))::BIGINT) AS bin, count(*) AS points, min(confidence) AS low, max(confidence) AS high, avg(confidence) AS mean_confidence, avg(accuracy) AS accuracy FROM r GROUP BY 1)"""


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User numbers as confidences, clamped values as accuracies."""
    return table(spark, sf_dir, "events").select("event_id", ((F.col("user_id") % 97) / 97.0).alias("confidence"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 100.0)).alias("accuracy"))


@query(f"{_BINS} SELECT bin, points, round(low, 6) AS low, round(high, 6) AS high, round(mean_confidence, 6) AS mean_confidence, round(accuracy, 6) AS accuracy FROM b")
def q_calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mt.calibration_bins(_points(spark, sf_dir))
    return got.select("bin", "points", *(F.round(c, 6).alias(c) for c in ("low", "high", "mean_confidence", "accuracy")))


@query(
    f"""{_BINS}, v AS (SELECT DISTINCT (user_id % 103) / 103.0::DOUBLE AS v FROM events), i AS (SELECT v, arg_min(accuracy, bin) AS a FROM v JOIN b ON v BETWEEN low AND high GROUP BY v),
j AS (SELECT v, arg_min(accuracy, struct_pack(d := abs(mean_confidence - v), k := bin)) AS a FROM v, b GROUP BY v) SELECT round(v, 6) AS confidence, round(coalesce(i.a, j.a), 6) AS calibrated FROM j LEFT JOIN i USING (v)"""
)
def q_calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "events").select(((F.col("user_id") % 103) / 103.0).alias("confidence")).distinct()
    got = mt.calibrated(values, mt.calibration_bins(_points(spark, sf_dir)), "confidence")
    return got.select(F.round("confidence", 6).alias("confidence"), F.round("calibrated", 6).alias("calibrated"))


@query("SELECT quality AS target, toxic AS predicted, count(*) AS n FROM labels GROUP BY 1, 2")
def q_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")


@query(
    """SELECT class, target_n::BIGINT AS target_n, predicted_n::BIGINT AS predicted_n, hits::BIGINT AS hits, round(hits / nullif(target_n + predicted_n - hits, 0), 6) AS iou FROM (
SELECT class, sum(t) AS target_n, sum(p) AS predicted_n, sum(d) AS hits FROM (SELECT quality AS class, 1 AS t, 0 AS p, (quality = toxic)::INT AS d FROM labels UNION ALL SELECT toxic, 0, 1, 0 FROM labels) GROUP BY class)"""
)
def q_class_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.class_iou(mt.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")).withColumn("iou", F.round("iou", 6))


@query("WITH c AS (SELECT label AS class, count(*) AS n FROM embeddings GROUP BY label) SELECT class, n, round(greatest(0.1, least(10.0, (1.0::DOUBLE / n) / (SELECT avg(1.0::DOUBLE / n) FROM c))), 6)::DOUBLE AS weight FROM c")
def q_class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("class")).agg(F.count("*").alias("n"))
    return mt.class_weights(counts).withColumn("weight", F.round("weight", 6))
