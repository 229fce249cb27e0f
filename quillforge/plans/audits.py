"""Audit queries: locks against files, expansions, suites against registries, intakes, captures, submissions, listings, job decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillforge.functions import values as vl
from quillforge.operators import audits as au
from quillforge.plans.corpus import _SPLIT
from quillforge.plans.inputs import duck, made
from quillforge.plans.registry import query
from quillforge.sources import manifests as mf
from quillforge.streaming import jobs as jb
from quillforge.tables import table

_HASH = "sha2(CAST({0} AS STRING), 256)"


def _sha(sql: str) -> str:
    """Shared SQL as a DuckDB subquery, Spark's hash function renamed."""
    import re

    return re.sub(r"sha2\((.+?), 256\)", r"sha256(\1)", duck(sql)).replace("AS STRING", "AS VARCHAR")


_LOCK = f"""SELECT doc_id AS id, source || '/' || doc_id AS source, {_HASH.format('doc_id')} AS source_sha256, CASE WHEN doc_id % 9 = 0 THEN '../' || doc_id ELSE 't/' || doc_id END AS ground_truth, {_HASH.format('doc_id + 1')} AS ground_truth_sha256,
CASE WHEN doc_id % 2 = 0 THEN 'l/' || doc_id END AS layout_ground_truth, CASE WHEN doc_id % 4 = 0 THEN {_HASH.format('doc_id')} END AS layout_ground_truth_sha256 FROM {{documents}}"""
_FILES = f"""SELECT source || '/' || doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN {_HASH.format('doc_id + 7')} ELSE {_HASH.format('doc_id')} END AS sha256 FROM {{documents}} WHERE lang <> 'en'
UNION ALL SELECT 't/' || doc_id, {_HASH.format('doc_id + 1')} FROM {{documents}} UNION ALL SELECT 'l/' || doc_id, {_HASH.format('doc_id')} FROM {{documents}}"""


@query(
    f"""WITH k AS {_sha(_LOCK)}, f AS {_sha(_FILES)}, e AS (SELECT id, 'source' AS kind, source AS path, source_sha256 AS want FROM k UNION ALL SELECT id, 'ground_truth', ground_truth, ground_truth_sha256 FROM k UNION ALL SELECT id, 'layout_ground_truth', layout_ground_truth, layout_ground_truth_sha256 FROM k WHERE layout_ground_truth IS NOT NULL)
SELECT * FROM (SELECT id, kind, CASE WHEN e.path LIKE '../%' THEN 'unsafe path' WHEN f.sha256 IS NULL THEN 'missing' WHEN f.sha256 IS DISTINCT FROM want THEN 'sha256 mismatch' END AS problem FROM e LEFT JOIN f ON f.path = e.path) WHERE problem IS NOT NULL"""
)
def q_lock_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as locked samples against files of which some lack, some have changed and some lie outside."""
    return au.lock_mismatches(made(spark, sf_dir, _LOCK), made(spark, sf_dir, _FILES))


_BOUND = "SELECT n, CASE WHEN n % 3 > 0 THEN 'a' END AS lock_sha256, CASE WHEN n % 3 = 1 THEN 'm' WHEN n % 3 = 2 THEN '' END AS frozen_manifest_sha256 FROM (SELECT DISTINCT user_id % 6 AS n FROM {events})"


@query(
    f"""WITH b AS {duck(_BOUND)}, p AS (SELECT x.n * 10 + y.n AS pair, x.lock_sha256 AS bl, x.frozen_manifest_sha256 AS bm, y.lock_sha256 || CASE WHEN y.n > 3 THEN 'b' ELSE '' END AS cl, y.frozen_manifest_sha256 AS cm FROM b x JOIN b y ON y.n = (x.n * 2 + 1) % 6),
q AS (SELECT *, bl IS NOT NULL OR bm IS NOT NULL AS tb, cl IS NOT NULL OR cm IS NOT NULL AS tc FROM p)
SELECT pair, 'one report is not bound' AS problem FROM q WHERE tb <> tc UNION ALL SELECT pair, 'lock_sha256 missing' FROM q WHERE tb AND tc AND (coalesce(bl, '') = '' OR coalesce(cl, '') = '') UNION ALL SELECT pair, 'lock_sha256 differs' FROM q WHERE tb AND tc AND bl <> '' AND cl <> '' AND bl <> cl
UNION ALL SELECT pair, 'frozen_manifest_sha256 missing' FROM q WHERE tb AND tc AND (coalesce(bm, '') = '' OR coalesce(cm, '') = '') UNION ALL SELECT pair, 'frozen_manifest_sha256 differs' FROM q WHERE tb AND tc AND bm <> '' AND cm <> '' AND bm <> cm"""
)
def q_freeze_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six bindings, each compared with another one."""
    rows = made(spark, sf_dir, _BOUND)
    found = []
    for n in range(6):
        m = (n * 2 + 1) % 6
        b, c = rows.where(F.col("n") == n), rows.where(F.col("n") == m).withColumn("lock_sha256", F.concat("lock_sha256", F.lit("b" if m > 3 else "")))
        found.append(au.freeze_binding(b, c).select(F.lit(n * 10 + m).alias("pair"), "problem"))
    from functools import reduce

    return reduce(DataFrame.unionByName, found)


_BASE = f"SELECT doc_id AS ord, CAST(doc_id AS STRING) AS id, lang || CAST(doc_id % 300 AS STRING) AS plain, {_HASH.format('doc_id % 900')} AS sha256, CASE WHEN doc_id % 5 = 0 THEN 'dev' ELSE 'train' END AS split FROM {{documents}} WHERE lang <> 'fr'"
_MORE = f"SELECT doc_id AS ord, CAST(doc_id AS STRING) AS id, CASE WHEN doc_id % 50 = 1 THEN 'changed' ELSE lang || CAST(doc_id % 300 AS STRING) END AS plain, {_HASH.format('doc_id % 900')} AS sha256, CASE WHEN doc_id % 5 = 0 AND doc_id % 35 > 0 THEN 'dev' ELSE 'train' END AS split FROM {{documents}} WHERE doc_id % 40 <> 3"


@query(
    f"""WITH b AS {_sha(_BASE)}, e AS {_sha(_MORE)}, d1 AS (SELECT row_number() OVER (ORDER BY ord) AS k, id AS a FROM b WHERE split = 'dev'), d2 AS (SELECT row_number() OVER (ORDER BY ord) AS k, id AS b FROM e WHERE split = 'dev'),
c1 AS (SELECT DISTINCT unnest(string_split(plain, '')) AS c FROM b), c2 AS (SELECT DISTINCT unnest(string_split(plain, '')) AS c FROM e)
SELECT problem, count(*) AS n, min(id) AS first FROM (SELECT 'baseline sample missing' AS problem, id FROM b WHERE id NOT IN (SELECT id FROM e) UNION ALL SELECT 'baseline sample changed', b.id FROM b JOIN e ON b.id = e.id WHERE b.plain <> e.plain OR b.sha256 <> e.sha256
UNION ALL SELECT 'development split changed', coalesce(a, b) FROM d1 FULL JOIN d2 ON d1.k = d2.k WHERE a IS DISTINCT FROM b UNION ALL SELECT 'no training sample added', NULL WHERE (SELECT count(*) FROM e WHERE split = 'train') <= (SELECT count(*) FROM b WHERE split = 'train')
UNION ALL SELECT 'text in training and development', id FROM e WHERE split = 'dev' AND plain IN (SELECT plain FROM e WHERE split = 'train') UNION ALL SELECT 'image in training and development', id FROM e WHERE split = 'dev' AND sha256 IN (SELECT sha256 FROM e WHERE split = 'train')
UNION ALL SELECT 'vocabulary changed', c FROM (SELECT c FROM c1 EXCEPT SELECT c FROM c2 UNION ALL (SELECT c FROM c2 EXCEPT SELECT c FROM c1))) GROUP BY problem"""
)
def q_expansion_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a training set and as its faulty expansion."""
    found = au.expansion_findings(made(spark, sf_dir, _BASE), made(spark, sf_dir, _MORE))
    return found.groupBy("problem").agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query(
    f"""WITH b AS {_sha(_BASE)}, e AS {_sha(_MORE)}, x AS (SELECT count(*) FILTER (WHERE split = 'train') AS baseline_train, count(*) FILTER (WHERE split = 'dev') AS baseline_dev, count(DISTINCT plain) FILTER (WHERE split = 'train') AS baseline_texts FROM b),
y AS (SELECT count(*) FILTER (WHERE split = 'train') AS expanded_train, count(*) FILTER (WHERE split = 'dev') AS expanded_dev, count(DISTINCT plain) FILTER (WHERE split = 'train') AS expanded_texts FROM e)
SELECT *, (SELECT count(DISTINCT plain) FROM e WHERE split = 'train' AND plain NOT IN (SELECT plain FROM b WHERE split = 'train')) AS added_texts, expanded_train - baseline_train AS added_train FROM x, y"""
)
def q_expansion_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return au.expansion_sizes(made(spark, sf_dir, _BASE), made(spark, sf_dir, _MORE))


@query(
    f"""WITH e AS (SELECT * FROM {_sha(_MORE)} WHERE split = 'dev'), b AS (SELECT * FROM {_sha(_BASE)} WHERE split = 'train')
SELECT problem, count(*) AS n, min(id) AS first FROM (SELECT 'text seen before' AS problem, id FROM e WHERE plain IN (SELECT plain FROM b) UNION ALL SELECT 'image seen before', id FROM e WHERE sha256 IN (SELECT sha256 FROM b) UNION ALL SELECT 'image twice', min(id) FROM e GROUP BY sha256 HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'character outside the vocabulary', id FROM (SELECT id, unnest(string_split(plain, '')) AS c FROM e) WHERE c NOT IN (SELECT DISTINCT unnest(string_split('endels0123456789', '')))) GROUP BY problem"""
)
def q_holdout_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The development part of one set against the training part of the other."""
    vocabulary = spark.createDataFrame([(c,) for c in sorted(set("endels0123456789"))], "char string")
    found = au.holdout_findings(made(spark, sf_dir, _MORE).where("split = 'dev'"), [made(spark, sf_dir, _BASE).where("split = 'train'")], vocabulary)
    return found.groupBy("problem").agg(F.count("*").alias("n"), F.min("id").alias("first"))


_REGISTRY = "SELECT 'p' || page_id AS id, CASE page_id % 4 WHEN 0 THEN 'remote-evaluation-candidate-not-approved' WHEN 1 THEN 'remote-evaluation-approved' WHEN 2 THEN 'local' END AS status, CASE page_id % 3 WHEN 0 THEN 'native' WHEN 1 THEN 'none' END AS text_layer, CAST(page_id % 7 AS INT) AS pages FROM {pages}"
_SUITE = "SELECT 'p' || page_id AS id, CASE page_id % 2 WHEN 0 THEN 'native' ELSE 'none' END AS expected_text_layer, CAST(page_id % 5 + 1 AS INT) AS last_page FROM {pages} UNION ALL SELECT 'missing', 'none', 1"


@query(f"SELECT id, status FROM {duck(_REGISTRY)} WHERE status LIKE 'remote-evaluation-%'")
def q_registry_remote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return au.registry_sources(made(spark, sf_dir, _REGISTRY)).select("id", "status")


_WANTED = "SELECT event_id AS ord, 'p' || user_id AS id FROM {events}"


@query(f"WITH w AS (SELECT id, min(ord) AS ord FROM {duck(_WANTED)} GROUP BY id) SELECT w.id, w.ord, CASE WHEN r.id IS NULL THEN 'unknown id' WHEN coalesce(status, '') NOT LIKE 'remote-evaluation-%' THEN 'not a remote source' END AS problem FROM w LEFT JOIN {duck(_REGISTRY)} r ON r.id = w.id")
def q_registry_wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of events as the sources asked for, each once, in order."""
    return au.registry_sources(made(spark, sf_dir, _REGISTRY), made(spark, sf_dir, _WANTED)).select("id", "ord", "problem")


@query(
    f"""WITH b AS (SELECT s.id, s.last_page, s.expected_text_layer, r.id IS NOT NULL AS there, status, text_layer, pages FROM {duck(_SUITE)} s LEFT JOIN {duck(_REGISTRY)} r ON r.id = s.id)
SELECT id, 'unknown id' AS problem FROM b WHERE NOT there UNION ALL SELECT id, 'status is not a candidate''s' FROM b WHERE there AND status IS DISTINCT FROM 'remote-evaluation-candidate-not-approved' UNION ALL SELECT id, 'text layer changed' FROM b WHERE there AND text_layer IS DISTINCT FROM expected_text_layer
UNION ALL SELECT id, 'no page count' FROM b WHERE there AND NOT coalesce(pages >= 1, false) UNION ALL SELECT id, 'page out of range' FROM b WHERE there AND pages >= 1 AND last_page > pages"""
)
def q_suite_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = made(spark, sf_dir, _SUITE).withColumn("pages", F.sequence(F.lit(1), F.col("last_page")))
    return au.suite_problems(entries, made(spark, sf_dir, _REGISTRY))


_HAVE = "SELECT doc_id AS id, source AS document_id, CASE WHEN doc_id % 40 = 0 THEN 'test' ELSE 'train' END AS split FROM {documents} WHERE doc_id % 3 = 0"
_NEW = "SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN source ELSE CAST(doc_id AS STRING) END AS document_id, CASE WHEN doc_id % 5 = 0 THEN 'development' WHEN doc_id % 5 = 1 THEN 'train' END AS split FROM {documents}"


@query(
    f"""WITH h AS {_sha(_HAVE)}, n AS {_sha(_NEW)}, p AS (SELECT document_id, min(split) AS has, count(DISTINCT split) AS splits FROM h GROUP BY document_id)
SELECT n.id, coalesce(has, n.split, {_SPLIT.format('n.document_id')}) AS chosen, CASE WHEN n.id IN (SELECT id FROM h) THEN 'id exists' WHEN splits > 1 THEN 'document in several splits' WHEN n.split IS NOT NULL AND has IS NOT NULL AND n.split <> has THEN 'document is in another split' END AS problem FROM n LEFT JOIN p ON p.document_id = n.document_id"""
)
def q_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return au.intake(made(spark, sf_dir, _HAVE), made(spark, sf_dir, _NEW)).select("id", "chosen", "problem")


_CAPTURED = "SELECT CASE page_id % 5 WHEN 0 THEN 'g' || page_id WHEN 1 THEN 'g' || CAST(page_id - 1 AS STRING) ELSE 'x' || page_id END || CASE page_id % 3 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' ELSE '.txt' END AS name, CASE page_id % 4 WHEN 0 THEN 'g' || page_id WHEN 1 THEN 'other' END AS decoded FROM {pages}"
_SHEET = "SELECT 'g' || page_id AS page, page_id % 2 = 0 AS requires_mark FROM {pages}"


@query(
    f"""WITH f AS (SELECT name, decoded, regexp_replace(name, '\\.[^.]*$', '') AS stem FROM {duck(_CAPTURED)} WHERE lower(regexp_extract(name, '\\.[^.]*$')) IN ('.jpg', '.png')), p AS {duck(_SHEET)},
j AS (SELECT f.*, m.page IS NOT NULL AS mark_known, n.page IS NOT NULL AS name_known, n.requires_mark FROM f LEFT JOIN p m ON m.page = f.decoded LEFT JOIN p n ON n.page = f.stem),
k AS (SELECT name, CASE WHEN decoded IS NOT NULL THEN decoded WHEN name_known THEN stem END AS page, CASE WHEN decoded IS NOT NULL THEN 'mark' ELSE 'name' END AS method, CASE WHEN decoded IS NOT NULL AND NOT mark_known THEN 'mark of another suite' WHEN decoded IS NOT NULL AND name_known AND stem <> decoded THEN 'name and mark differ'
WHEN decoded IS NULL AND name_known AND requires_mark THEN 'mark not readable' WHEN decoded IS NULL AND NOT name_known THEN 'unknown page' END AS problem FROM j)
SELECT name, page, method, coalesce(problem, CASE WHEN page IS NOT NULL AND count(page) OVER (PARTITION BY page) > 1 THEN 'several files of a page' END) AS problem FROM k"""
)
def q_capture_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files of captures, named and marked in all the ways that can go wrong."""
    return au.capture_files(made(spark, sf_dir, _CAPTURED), made(spark, sf_dir, _SHEET), [".jpg", ".png"])


_TAKEN = "SELECT 'g' || page_id AS page, page_id % 7 > 0 AS visible, page_id % 11 = 0 AS digital_copy FROM {pages} WHERE page_id % 4 > 0"
_HAD = "SELECT 'g' || page_id || '-c1' AS id FROM {pages} WHERE page_id % 13 = 0"


@query(
    f"""WITH t AS {duck(_TAKEN)} SELECT page, 'missing' AS problem FROM {duck(_SHEET)} WHERE page NOT IN (SELECT page FROM t) UNION ALL SELECT page, 'sample exists' FROM t WHERE page || '-c1' IN (SELECT id FROM {duck(_HAD)})
UNION ALL SELECT page, 'too little content' FROM t WHERE NOT visible UNION ALL SELECT page, 'digital copy' FROM t WHERE digital_copy"""
)
def q_capture_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return au.capture_plan(made(spark, sf_dir, _SHEET), made(spark, sf_dir, _TAKEN), made(spark, sf_dir, _HAD), "c1")


_COMPARED = "SELECT event_id, value / 5000 AS aspect, value / 20 AS mae, event_id % 16 AS a, user_id % 16 AS b, value / 10000 AS ink FROM {events}"


@query(f"SELECT event_id, bit_count(xor(a, b))::INT AS distance, aspect <= 0.005 AND mae <= 3.0 AND bit_count(xor(a, b)) <= 2 AS digital_copy, ink >= 0.003 AS visible FROM {duck(_COMPARED)}")
def q_authenticity(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = made(spark, sf_dir, _COMPARED).select("event_id", au.authenticity(F.col("aspect"), F.col("mae"), F.col("a"), F.col("b"), F.col("ink")).alias("x"))
    return got.select("event_id", F.col("x.distance").cast("int").alias("distance"), "x.digital_copy", "x.visible")


_MEMBERS = f"SELECT CASE WHEN page_id % 17 = 0 THEN '../' || page_id ELSE 'captures/g' || CAST(page_id - page_id % 2 * (page_id % 3) AS STRING) || '.png' END AS name, page_id AS size, {_HASH.format('page_id')} AS sha256 FROM {{pages}} UNION ALL SELECT 'SHA256SUMS', 1, 'x'"
_SUMS = f"SELECT 'captures/g' || page_id || '.png' AS name, CASE WHEN page_id % 10 = 0 THEN 'short' WHEN page_id % 10 = 1 THEN {_HASH.format('page_id + 1')} ELSE {_HASH.format('page_id')} END AS digest FROM {{pages}}"
_RECORDS = f"SELECT 'g' || CAST(page_id % 150 AS STRING) AS page_id, 'g' || CAST(page_id % 150 AS STRING) || CASE WHEN page_id % 6 = 0 THEN '.gif' ELSE '.png' END AS filename, 'captures/g' || CAST(page_id % 150 AS STRING) || '.png' AS member, page_id AS size_bytes, {_HASH.format('page_id')} AS sha256 FROM {{pages}} WHERE page_id < 160"


@query(
    f"""WITH m AS {_sha(_MEMBERS)}, s AS {_sha(_SUMS)}, r AS {_sha(_RECORDS)}, g AS (SELECT name, count(*) AS n, max(size) AS size, max(sha256) AS actual FROM m GROUP BY name), d AS (SELECT name, count(*) AS times, max(lower(digest)) AS digest FROM s GROUP BY name),
b AS (SELECT coalesce(g.name, d.name) AS name, n, actual, times, digest FROM (SELECT * FROM g WHERE name <> 'SHA256SUMS') g FULL JOIN d ON d.name = g.name), q AS (SELECT r.*, count(*) OVER (PARTITION BY page_id) AS times, g.size AS has, g.actual FROM r LEFT JOIN g ON g.name = r.member)
SELECT subject, problem, count(*) AS n FROM (SELECT name AS subject, 'duplicate member' AS problem FROM b WHERE n > 1 UNION ALL SELECT name, 'unsafe member' FROM b WHERE name LIKE '../%' UNION ALL SELECT name, 'no checksum' FROM b WHERE digest IS NULL UNION ALL SELECT name, 'checksum without member' FROM b WHERE n IS NULL
UNION ALL SELECT name, 'duplicate checksum' FROM b WHERE times > 1 UNION ALL SELECT name, 'bad digest' FROM b WHERE NOT regexp_full_match(digest, '[0-9a-f]{{64}}') UNION ALL SELECT name, 'checksum mismatch' FROM b WHERE actual <> digest
UNION ALL SELECT 'capture-submission.json', 'required file missing' UNION ALL SELECT page_id, 'page twice' FROM q WHERE times > 1 UNION ALL SELECT page_id, 'bad member name' FROM q WHERE member <> 'captures/' || filename OR filename LIKE '%.gif' UNION ALL SELECT page_id, 'capture missing' FROM q WHERE actual IS NULL
UNION ALL SELECT page_id, 'capture differs' FROM q WHERE has <> size_bytes OR actual <> sha256 UNION ALL SELECT name, 'capture without record' FROM g WHERE name LIKE 'captures/%' AND name NOT IN (SELECT member FROM r)) GROUP BY ALL"""
)
def q_submission_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as members, checksums and records of a package that disagree in all ways."""
    found = au.submission_problems(made(spark, sf_dir, _MEMBERS), made(spark, sf_dir, _SUMS), made(spark, sf_dir, _RECORDS), [".jpg", ".png"])
    return found.groupBy("subject", "problem").agg(F.count("*").alias("n"))


@query("WITH l AS (SELECT conv_id AS part, turn AS pos FROM conversations WHERE trim(text) <> '') SELECT part, pos, (row_number() OVER (ORDER BY part, pos) - 1) * 4 AS first_sample FROM l")
def q_sample_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as corpus lines, four variants of each."""
    lines = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("part"), F.col("turn").alias("pos"), "text")
    return au.sample_offsets(lines, 4).select("part", "pos", "first_sample")


_TAGGED = "SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'capture:phone-photo' WHEN 1 THEN 'capture:flatbed-scan' ELSE lang END AS one, CASE doc_id % 6 WHEN 0 THEN 'capture:flatbed-scan' ELSE source END AS two, CASE doc_id % 5 WHEN 0 THEN 'clean-print' WHEN 1 THEN 'noisy-scan' WHEN 2 THEN 'phone-photo' ELSE 'form' END AS subset FROM {documents}"
_FALLBACK = {"clean-print": "flatbed-scan", "noisy-scan": "degraded-scan", "phone-photo": "phone-photo"}


@query(
    f"""SELECT id, CASE WHEN len(m) > 0 THEN array_to_string(list_sort(list_distinct(m)), ',') ELSE coalesce(CASE subset WHEN 'clean-print' THEN 'flatbed-scan' WHEN 'noisy-scan' THEN 'degraded-scan' WHEN 'phone-photo' THEN 'phone-photo' END, '') END AS modes
FROM (SELECT *, list_transform(list_filter([one, two], lambda t: t LIKE 'capture:%'), lambda t: substr(t, 9)) AS m FROM {duck(_TAGGED)})"""
)
def q_capture_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    modes = au.capture_modes(F.array("one", "two"), F.col("subset"), _FALLBACK)
    return made(spark, sf_dir, _TAGGED).select("id", F.array_join(modes, ",").alias("modes"))


@query("SELECT count(*) FILTER (WHERE doc_id IN (SELECT page_id FROM pages)) AS registered, count(*) FILTER (WHERE doc_id NOT IN (SELECT page_id FROM pages)) AS unexpected FROM documents")
def q_registered_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return au.registered(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id")), table(spark, sf_dir, "pages").select(F.col("page_id").alias("page")))


_SHARDS = "SELECT page_id AS pos, CASE WHEN page_id % 9 = 0 THEN ' ' WHEN page_id % 8 = 0 THEN 'http://h/' || page_id ELSE 'https://h/' || CASE page_id % 4 WHEN 0 THEN CAST(page_id % 12 AS STRING) || '_' WHEN 1 THEN 'x_' ELSE CAST(page_id % 7 AS STRING) || '_a_' END || page_id || CASE page_id % 2 WHEN 0 THEN '.jsonl.zst' ELSE '.txt' END END AS line FROM {pages}"


@query(
    f"""WITH u AS (SELECT trim(line) AS url FROM {duck(_SHARDS)} WHERE trim(line) LIKE 'https://%'), b AS (SELECT url, coalesce(TRY_CAST(regexp_extract(url, '/([0-9]+)[^/]*$', 1) AS INT), -1) AS quality, regexp_extract(url, '[^/]*$') AS name FROM u)
SELECT row_number() OVER (ORDER BY CASE WHEN regexp_matches(name, '^[0-9]+(_|$)') THEN quality ELSE -1 END DESC, url DESC) AS place, url, CASE WHEN regexp_matches(name, '^[0-9]+(_|$)') THEN quality ELSE -1 END AS quality,
CASE WHEN url LIKE '%.jsonl.zst' THEN regexp_replace(url, '[^/]*$', '') || '.' || regexp_replace(name, '\\.zst$', '') || '.md5' ELSE url || '.md5' END AS checksum FROM b"""
)
def q_shard_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = vl.shard_map(made(spark, sf_dir, _SHARDS))
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy(F.desc("quality"), F.desc("url")))  # a map lists shards, not documents
    return good.select(place.cast("long").alias("place"), "url", "quality", vl.checksum_url(F.col("url")).alias("checksum"))


@query(f"SELECT trim(line) AS url, 'not HTTPS' AS problem FROM {duck(_SHARDS)} WHERE trim(line) <> '' AND trim(line) NOT LIKE 'https://%'")
def q_shard_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vl.shard_map(made(spark, sf_dir, _SHARDS))[1]


# --- job decisions -------------------------------------------------------------------------------------------------------

_STEPS = "SELECT user_id AS job_id, event_id AS ord, CASE event_type WHEN 'view' THEN CASE event_id % 3 WHEN 0 THEN 'reserve' WHEN 1 THEN 'enqueue' ELSE 'start' END WHEN 'click' THEN 'start' WHEN 'purchase' THEN 'succeed' WHEN 'signup' THEN 'cancel' ELSE 'fail' END AS event FROM {events}"


@query(
    f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ord) AS i FROM {duck(_STEPS)}), s AS (SELECT DISTINCT job_id, 0::BIGINT AS i, NULL::BIGINT AS ord, NULL::VARCHAR AS event, NULL::VARCHAR AS status, false AS cancel, false AS taken FROM e
UNION ALL SELECT e.job_id, e.i, e.ord, e.event, CASE WHEN e.event = 'reserve' THEN coalesce(s.status, 'uploading') WHEN s.status IS NULL OR s.status IN ('succeeded', 'failed', 'cancelled') THEN s.status WHEN e.event = 'cancel' THEN CASE s.status WHEN 'queued' THEN 'cancelled' ELSE s.status END
WHEN e.event = 'enqueue' AND s.status = 'uploading' THEN CASE WHEN s.cancel THEN 'cancelled' ELSE 'queued' END WHEN e.event = 'start' AND s.status = 'queued' THEN CASE WHEN s.cancel THEN 'cancelled' ELSE 'running' END
WHEN e.event = 'succeed' AND s.status = 'running' THEN CASE WHEN s.cancel THEN 'cancelled' ELSE 'succeeded' END WHEN e.event = 'fail' AND s.status = 'running' THEN 'failed' ELSE s.status END,
s.cancel OR (e.event = 'cancel' AND coalesce(s.status NOT IN ('succeeded', 'failed', 'cancelled'), false)),
CASE WHEN e.event = 'reserve' THEN s.status IS NULL WHEN s.status IS NULL OR s.status IN ('succeeded', 'failed', 'cancelled') THEN false WHEN e.event = 'cancel' THEN NOT s.cancel ELSE (e.event = 'enqueue' AND s.status = 'uploading') OR (e.event = 'start' AND s.status = 'queued') OR (e.event IN ('succeed', 'fail') AND s.status = 'running') END
FROM s JOIN e ON e.job_id = s.job_id AND e.i = s.i + 1) SELECT job_id, ord, event, status, taken FROM s WHERE i > 0"""
)
def q_job_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as steps of one job."""
    rows = made(spark, sf_dir, _STEPS).withColumn("job_id", F.col("job_id").cast("string"))
    return jb.lifecycle(rows).withColumn("job_id", F.col("job_id").cast("long"))


_LOADS = "SELECT user_id % 10 AS manager, event_id AS ord, CASE event_type WHEN 'purchase' THEN 'finish' WHEN 'error' THEN 'drop' ELSE 'reserve' END AS kind, event_id % 3 + 1 AS n FROM {events}"


@query(
    f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY manager ORDER BY ord) AS i FROM {duck(_LOADS)}), s AS (SELECT DISTINCT manager, 0::BIGINT AS i, NULL::BIGINT AS ord, NULL::VARCHAR AS refused, 0::BIGINT AS active, 0::BIGINT AS retained FROM e
UNION ALL SELECT e.manager, e.i, e.ord, CASE WHEN e.kind = 'reserve' THEN CASE WHEN s.active + e.n > 6 THEN 'capacity' WHEN s.retained + e.n > 20 THEN 'retained' END END,
CASE e.kind WHEN 'finish' THEN greatest(0, s.active - e.n) WHEN 'drop' THEN s.active ELSE CASE WHEN s.active + e.n > 6 OR s.retained + e.n > 20 THEN s.active ELSE s.active + e.n END END,
CASE e.kind WHEN 'finish' THEN s.retained WHEN 'drop' THEN greatest(s.active, s.retained - e.n) ELSE CASE WHEN s.active + e.n > 6 OR s.retained + e.n > 20 THEN s.retained ELSE s.retained + e.n END END FROM s JOIN e ON e.manager = s.manager AND e.i = s.i + 1)
SELECT manager, ord, refused, active, retained FROM s WHERE i > 0"""
)
def q_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as reservations, ends and drops of jobs on ten managers of six running and twenty kept jobs."""
    return jb.admissions(made(spark, sf_dir, _LOADS), "manager", 6, 20).select("manager", "ord", "refused", "active", "retained")


_LEASES = "SELECT user_id AS manager, event_id AS ord, CASE WHEN event_id % 5 < 3 THEN 'acquire' ELSE 'release' END AS kind, 'l' || CAST(event_id % 12 AS STRING) AS lease, 'j' || event_type AS job, event_id % 9 > 0 AS ready FROM {events}"


@query(
    f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY manager ORDER BY ord) AS i FROM {duck(_LEASES)}), s AS (SELECT DISTINCT manager, 0::BIGINT AS i, NULL::BIGINT AS ord, NULL::VARCHAR AS refused, []::VARCHAR[] AS held, NULL::VARCHAR AS job FROM e
UNION ALL SELECT e.manager, e.i, e.ord, CASE WHEN e.kind = 'release' THEN NULL WHEN NOT e.ready THEN 'not ready' WHEN len(list_filter(s.held, lambda x: string_split(x, '/')[1] = e.lease)) > 0 OR len(list_filter(s.held, lambda x: string_split(x, '/')[2] = e.job)) >= 4 OR len(s.held) >= 9 THEN 'capacity' END,
CASE WHEN e.kind = 'release' THEN list_filter(s.held, lambda x: string_split(x, '/')[1] <> e.lease) WHEN NOT e.ready OR len(list_filter(s.held, lambda x: string_split(x, '/')[1] = e.lease)) > 0 OR len(list_filter(s.held, lambda x: string_split(x, '/')[2] = e.job)) >= 4 OR len(s.held) >= 9 THEN s.held ELSE list_append(s.held, e.lease || '/' || e.job) END, e.job
FROM s JOIN e ON e.manager = s.manager AND e.i = s.i + 1) SELECT manager, ord, refused, len(list_filter(held, lambda x: string_split(x, '/')[2] = job)) AS open_of_job, len(held) AS open_of_all FROM s WHERE i > 0"""
)
def q_download_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as downloads opened and closed on a manager for each user, of nine downloads, four of one job."""
    return jb.leases(made(spark, sf_dir, _LEASES), "manager", 4, 9).select("manager", "ord", "refused", "open_of_job", "open_of_all")


_JOURNAL = "SELECT CAST(page_id AS STRING) AS job_id, CASE WHEN page_id % 3 = 0 THEN 'a' || page_id END AS artifact_key, page_id % 5 > 0 AS workspace_pending, CAST(page_id % 4 AS INT) AS failures FROM {pages} WHERE page_id % 2 = 0"
_CHANGES = "SELECT CASE page_id % 4 WHEN 0 THEN 'expire' WHEN 1 THEN 'add' WHEN 2 THEN 'update' ELSE 'add' END AS op, CAST(page_id AS STRING) AS job_id, CASE WHEN page_id % 3 = 0 THEN 'a' || page_id END AS artifact_key, page_id % 8 > 2 OR page_id % 4 = 0 AS workspace_pending, CAST(page_id % 3 AS INT) AS failures FROM {pages}"


@query(
    f"""WITH j AS {_sha(_JOURNAL)}, c AS {_sha(_CHANGES)} SELECT c.job_id, 'publication is not owned' AS problem FROM c JOIN j ON j.job_id = c.job_id WHERE op = 'expire' AND NOT (c.artifact_key IS NOT DISTINCT FROM j.artifact_key AND j.workspace_pending)
UNION ALL SELECT c.job_id, 'job is known' FROM c JOIN j ON j.job_id = c.job_id WHERE op = 'add' UNION ALL SELECT job_id, 'job is unknown' FROM c WHERE op = 'update' AND job_id NOT IN (SELECT job_id FROM j)"""
)
def q_journal_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return jb.journal_step(made(spark, sf_dir, _JOURNAL).withColumn("retry_at", at), made(spark, sf_dir, _CHANGES).withColumn("retry_at", at), 1 << 30)[1]


_ADDS = "SELECT CASE WHEN page_id % 2 = 1 THEN 'add' ELSE 'update' END AS op, CAST(page_id AS STRING) AS job_id, CASE WHEN page_id % 3 = 0 THEN 'a' || page_id END AS artifact_key, page_id % 8 > 2 AS workspace_pending, CAST(page_id % 3 AS INT) AS failures FROM {pages} WHERE page_id % 5 > 0"


@query(
    f"""WITH j AS {_sha(_JOURNAL)}, c AS {_sha(_ADDS)} SELECT job_id, artifact_key, workspace_pending, failures FROM j WHERE job_id NOT IN (SELECT job_id FROM c)
UNION ALL SELECT job_id, artifact_key, workspace_pending, failures FROM c WHERE op = 'add' OR artifact_key IS NOT NULL OR workspace_pending"""
)
def q_journal_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A journal of even pages after a batch without problems."""
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return jb.journal_step(made(spark, sf_dir, _JOURNAL).withColumn("retry_at", at), made(spark, sf_dir, _ADDS).withColumn("retry_at", at), 1 << 30)[0].drop("retry_at")


_UPLOADS = "SELECT user_id % 40 AS page, event_id AS ord, CASE WHEN event_id % 4 = 0 THEN 'delete' ELSE 'upload' END AS kind, CASE WHEN event_id % 4 > 0 THEN 'f' || event_id END AS name FROM {events}"


@query(
    f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY ord) AS i FROM {duck(_UPLOADS)}), s AS (SELECT DISTINCT page, 0::BIGINT AS i, NULL::BIGINT AS ord, false AS taken, NULL::VARCHAR AS file FROM e
UNION ALL SELECT e.page, e.i, e.ord, e.kind = 'delete' OR s.file IS NULL, CASE WHEN e.kind = 'delete' THEN NULL ELSE coalesce(s.file, e.name) END FROM s JOIN e ON e.page = s.page AND e.i = s.i + 1) SELECT page, ord, taken, file FROM s WHERE i > 0"""
)
def q_capture_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jb.captures(made(spark, sf_dir, _UPLOADS)).select("page", "ord", "taken", "file")


_PARTS = "SELECT page_id AS page_no, page_id AS n FROM {pages}"


@query("SELECT 'u' || lpad(page_id::VARCHAR, 9, '0') AS key, i::VARCHAR AS upload_id FROM pages, range(3) t(i) WHERE page_id < (SELECT min(page_id) + 20 FROM pages)")
def q_multipart_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a listing in order, of which the twentieth-first goes back to an earlier marker."""
    rows = made(spark, sf_dir, _PARTS)
    first = rows.agg(F.min("page_no").alias("low"))
    name = lambda c: F.concat(F.lit("u"), F.lpad(c.cast("string"), 9, "0"))
    uploads = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct(name(F.col("n")).alias("key"), i.cast("string").alias("upload_id")))
    marker = F.when(F.col("page_no") == F.col("low") + 20, name(F.col("low"))).otherwise(name(F.col("n") + 1))
    listing = rows.join(F.broadcast(first), F.lit(True)).select("page_no", marker.alias("key_marker"), F.lit("0").alias("upload_marker"), uploads.alias("uploads"))
    return mf.multipart_listing(listing, "u")[0].select("key", "upload_id")
