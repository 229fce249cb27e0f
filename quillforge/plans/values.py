"""Queries over small values: keys, payloads, sizes, profiles, timestamps, confidences, file names, page samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillforge.functions import text as tx
from quillforge.functions import values as vl
from quillforge.plans.inputs import duck, made
from quillforge.plans.registry import query
from quillforge.tables import table


@query("SELECT event_id, user_id || ',' || event_id % 7 AS key, user_id::INT AS first, 2 AS n FROM events")
def q_context_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of two ids as keys, and parsed again."""
    key = vl.context_key(F.array("user_id", F.col("event_id") % 7))
    rows = table(spark, sf_dir, "events").select("event_id", key.alias("key"))
    ids = vl.parse_context_key(F.col("key"))
    return rows.select("event_id", "key", F.get(ids, F.lit(0)).alias("first"), F.size(ids).alias("n"))


_MARKS = "SELECT page_id, CASE page_id % 3 WHEN 0 THEN ' p' || page_id || ' ' WHEN 1 THEN ' ' ELSE 'q' || page_id END AS page FROM {pages}"


@query(f"SELECT page_id, CASE WHEN trim(page) <> '' THEN 'page:' || trim(page) END AS payload, CASE WHEN trim(page) <> '' THEN trim(page) END AS back, NULL::VARCHAR AS other FROM {duck(_MARKS)}")
def q_page_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, sf_dir, _MARKS).withColumn("payload", vl.page_payload(F.col("page"), "page:"))
    return rows.select("page_id", "payload", vl.payload_page(F.col("payload"), "page:").alias("back"), vl.payload_page(F.col("page"), "page:").alias("other"))


@query("SELECT DISTINCT user_id, format('{:,}', (user_id + 1) * 5000) || ' ₭' AS amount FROM events")
def q_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", vl.amount(F.col("user_id")).alias("amount")).distinct()


_LADDER = "SELECT DISTINCT CAST(user_id % 30 AS INT) AS least, CAST(user_id % 30 + user_id % 17 - 2 AS INT) AS most FROM {events}"


@query(
    f"""WITH l AS {duck(_LADDER)}, s AS (SELECT *, greatest(1, ceil((most - least) / 4.0))::INT AS step FROM l), r AS (SELECT *, range(least, most + 1, step) AS sizes FROM s)
SELECT least, most, CASE WHEN least >= 8 AND most >= least THEN array_to_string(CASE WHEN list_contains(sizes, most) THEN sizes ELSE list_append(sizes, most::BIGINT) END, ',') END AS sizes FROM r"""
)
def q_font_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, _LADDER).select("least", "most", F.array_join(vl.font_sizes(F.col("least"), F.col("most")), ",").alias("sizes"))


_PLANNED = "SELECT event_id AS sample, CASE event_id % 4 WHEN 0 THEN 'clean-scan' ELSE 'balanced' END AS requested, user_id AS line, event_id % 3 AS variant FROM {events}"


@query(
    f"""WITH p AS (SELECT *, CASE WHEN requested = 'balanced' THEN ['clean-scan', 'noisy-scan', 'phone-photo'][sample % 3 + 1] ELSE requested END AS profile FROM {duck(_PLANNED)})
SELECT sample, profile, (CASE WHEN requested = 'balanced' THEN sample // 3 + sample % 3 ELSE line + variant END % 5)::INT AS font, CASE profile WHEN 'clean-scan' THEN 1.5 WHEN 'noisy-scan' THEN 8.0 ELSE 5.0 END::DOUBLE AS noise_std, CASE profile WHEN 'clean-scan' THEN 92 WHEN 'noisy-scan' THEN 55 ELSE 65 END AS jpeg_quality_min FROM p"""
)
def q_sample_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile, font and limits of generated samples."""
    rows = made(spark, sf_dir, _PLANNED)
    planned = rows.select("sample", vl.profile_of(F.col("requested"), F.col("sample")).alias("profile"), vl.font_index(F.col("requested"), F.col("sample"), F.col("line"), F.col("variant"), F.lit(5)).alias("font"))
    return planned.join(F.broadcast(vl.profiles(spark)), "profile").select("sample", "profile", "font", "noise_std", "jpeg_quality_min")  # three rows


@query()
def q_seeded_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distortions that the generator draws for the number of each event."""
    rows = made(spark, sf_dir, _PLANNED).select(F.col("sample").alias("seed"), vl.profile_of(F.col("requested"), F.col("sample")).alias("profile"))
    return vl.seeded_draws(rows.join(F.broadcast(vl.profiles(spark)), "profile")).select("seed", *(F.round(f"draw.{c.split()[0]}", 9).alias(c.split()[0]) for c in vl.DRAW.split(", ")))


_HEADERS = "SELECT event_id, CASE event_id % 4 WHEN 0 THEN ' id-' || event_id WHEN 1 THEN 'bad id' WHEN 2 THEN '' END AS supplied, CASE event_id % 3 WHEN 0 THEN ' 10.0.0.' || user_id || ', 1.1.1.1' WHEN 1 THEN ' ,x' END AS forwarded, CASE event_id % 5 WHEN 0 THEN '' ELSE 'h' || user_id END AS host FROM {events}"


@query(
    f"""SELECT event_id, CASE WHEN regexp_full_match(trim(coalesce(supplied, '')), '[\\p{{L}}\\p{{N}}._-]{{1,128}}') THEN trim(supplied) ELSE 'fresh' END AS request, CASE WHEN trim(split_part(coalesce(forwarded, ''), ',', 1)) <> '' THEN trim(split_part(forwarded, ',', 1)) WHEN coalesce(host, '') <> '' THEN host ELSE 'unknown' END AS behind_proxy,
CASE WHEN coalesce(host, '') <> '' THEN host ELSE 'unknown' END AS direct FROM {duck(_HEADERS)}"""
)
def q_request_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = made(spark, sf_dir, _HEADERS)
    return h.select("event_id", vl.request_id(F.col("supplied"), F.lit("fresh")).alias("request"), vl.client_key(F.col("forwarded"), F.col("host"), True).alias("behind_proxy"), vl.client_key(F.col("forwarded"), F.col("host"), False).alias("direct"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || lpad((epoch_us(ts) % 1000000)::VARCHAR, 6, '0') END || '+00:00' AS stamp FROM events")
def q_utc_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", vl.utc_stamp(F.col("ts").cast("timestamp")).alias("stamp"))


@query("SELECT event_id, round(greatest(0, least(1, exp((20 - value) / greatest(1, event_id % 30)))), 6) AS beam, CASE WHEN event_id % 4 = 0 THEN 0 ELSE round((exp(greatest(-value / 100, -0.5::DOUBLE)) + exp(-0.25::DOUBLE)) / 2, 6) END AS greedy FROM events WHERE value IS NOT NULL")
def q_confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = lambda *v: F.array(*(x if not isinstance(x, float) else F.lit(x) for x in v))
    lattice = F.array(step(-F.col("value") / 100, -0.5), step(-0.25, -3.0))
    lattice = F.when(F.col("event_id") % 4 == 0, F.array().cast("array<array<double>>")).otherwise(lattice)
    rows = table(spark, sf_dir, "events").where("value is not null")
    return rows.select("event_id", F.round(vl.beam_confidence(20 - F.col("value"), F.col("event_id") % 30), 6).alias("beam"), F.round(vl.greedy_confidence(lattice), 6).alias("greedy"))


_COUNTS = "SELECT DISTINCT CAST(user_id % 13 + 1 AS INT) AS count, CAST(event_id % 7 + 1 AS INT) AS most, CAST(event_id % 5 AS INT) AS asked FROM {events}"


@query(
    f"""WITH c AS {duck(_COUNTS)}, p AS (SELECT count, most, asked, unnest(range(1, count + 1))::INT AS page FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY count, most, asked ORDER BY CASE page WHEN 1 THEN 0 WHEN (count + 1) // 2 THEN 1 WHEN count THEN 2 ELSE 3 END, page) AS k FROM p),
s AS (SELECT count, most, asked, string_agg(page, ',' ORDER BY page) FILTER (WHERE k <= most) AS own FROM r GROUP BY ALL)
SELECT count, most, asked, CASE WHEN most = 1 OR count = 1 THEN '1' WHEN most = 2 THEN '1,' || count ELSE own END AS sampled, CASE WHEN asked = 0 THEN CASE WHEN most = 1 OR count = 1 THEN '1' WHEN most = 2 THEN '1,' || count ELSE own END WHEN asked + 2 > count THEN NULL WHEN most = 1 THEN (asked + 2)::VARCHAR ELSE (asked + 2) || ',1' END AS wanted FROM s"""
)
def q_page_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to look at by number of pages and limit, alone and with pages asked for (one of them twice)."""
    asked = F.when(F.col("asked") > 0, F.array(F.col("asked") + 2, F.lit(1), F.col("asked") + 2))
    rows = made(spark, sf_dir, _COUNTS)
    own, wanted = vl.page_sample(F.col("count"), F.col("most")), vl.page_sample(F.col("count"), F.col("most"), asked)
    return rows.select("count", "most", "asked", F.array_join(own, ",").alias("sampled"), F.array_join(wanted, ",").alias("wanted"))


_NAMES = r"SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'a/b\\' || lang || ' ' || doc_id || '.PDF' WHEN 1 THEN '  ..x  y?' || doc_id || '.tar.GZ ' WHEN 2 THEN '..' WHEN 3 THEN 'dir/' WHEN 4 THEN '.hidden' || doc_id WHEN 5 THEN 'né' || source || '*.p-g' WHEN 6 THEN 'dots. . .' || doc_id || '.' ELSE coalesce(text, '') END AS name FROM {documents}"


@query(
    r"""WITH n AS (SELECT doc_id, trim(regexp_replace(replace(nfc_normalize(name), chr(92), '/'), '^.*/', '', 's'), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160)) AS base FROM (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'a/b' || chr(92) || lang || ' ' || doc_id || '.PDF' WHEN 1 THEN '  ..x  y?' || doc_id || '.tar.GZ ' WHEN 2 THEN '..' WHEN 3 THEN 'dir/' WHEN 4 THEN '.hidden' || doc_id WHEN 5 THEN 'né' || source || '*.p-g' WHEN 6 THEN 'dots. . .' || doc_id || '.' ELSE coalesce(text, '') END AS name FROM documents)),
s AS (SELECT doc_id, base, regexp_extract(base, '^.+(\.[^.]+)$', 1, 's') AS suffix FROM n), t AS (SELECT doc_id, base, lower(suffix) AS suffix, left(base, length(base) - length(suffix)) AS stem FROM s),
c AS (SELECT doc_id, base, regexp_replace(regexp_replace(suffix, '\p{C}', '', 'g'), '[^\p{L}\p{N}._-]', '_', 'g') AS suffix, trim(regexp_replace(regexp_replace(regexp_replace(stem, '\p{C}', '', 'g'), '[^\p{L}\p{M}\p{N} ._-]', '_', 'g'), ' +', ' ', 'g'), ' .') AS stem FROM t)
SELECT doc_id, CASE WHEN base IN ('', '.', '..') THEN 'document' ELSE CASE WHEN rtrim(left(stem, 120), ' .') = '' THEN 'document' ELSE rtrim(left(stem, 120), ' .') END || suffix END AS name FROM c"""
)
def q_safe_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Awkward names made of documents' columns, and their whole texts as names."""
    return made(spark, sf_dir, _NAMES).select("doc_id", tx.safe_filename(F.col("name")).alias("name"))
