"""Service queries: events as requests, orders as jobs, pages as an inventory."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillforge.functions import text as tx
from quillforge.operators import rollups as ro
from quillforge.plans.inputs import duck, made
from quillforge.plans.registry import query
from quillforge.sources.manifests import CATEGORIES, inventory
from quillforge.streaming import cleanup as cl
from quillforge.streaming import jobs as jb
from quillforge.streaming import limits
from quillforge.tables import table


_PATH = """CASE event_type WHEN 'view' THEN '/v1/jobs/' || user_id WHEN 'click' THEN '/v1/jobs/' || user_id || '/download' WHEN 'purchase' THEN '/v1/jobs/batch' WHEN 'signup' THEN '/v1/health/' || user_id % 3 ELSE '/v1/jobs/' || user_id % 5 || '/x"y' END"""
_REQUESTS = f"SELECT event_id, upper(event_type) AS method, {_PATH} AS path, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, value AS seconds FROM {{events}}"
_ROUTED = f"""q AS {duck(_REQUESTS)}, r AS (SELECT *, CASE WHEN path = '/v1/jobs/batch' THEN path WHEN regexp_full_match(path, '/v1/jobs/[^/]+/download') THEN '/v1/jobs/{{job_id}}/download' WHEN regexp_full_match(path, '/v1/jobs/[^/]+') THEN '/v1/jobs/{{job_id}}' ELSE path END AS route FROM q),
m AS (SELECT method, route, status, count(*) AS n, round(sum(greatest(0.0, seconds)), 4)::DOUBLE AS seconds FROM r GROUP BY ALL)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests: the type is the method and decides the path, the value the seconds."""
    return made(spark, sf_dir, _REQUESTS).withColumn("route", tx.route(F.col("path")))


@query(f"WITH {_ROUTED} SELECT * FROM m")
def q_request_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jb.request_metrics(requests(spark, sf_dir)).withColumn("seconds", F.round("seconds", 4))


@query(f"WITH {_ROUTED} SELECT method, route, sum(n)::BIGINT AS n, round(sum(seconds), 3)::DOUBLE AS seconds FROM m GROUP BY ALL")
def q_request_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jb.request_durations(jb.request_metrics(requests(spark, sf_dir))).withColumn("seconds", F.round("seconds", 3))


@query(f"""WITH {_ROUTED} SELECT row_number() OVER (ORDER BY method, route, status) AS place, 'requests_total{{method="' || method || '",route="' || replace(replace(route, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '",status="' || status || '"}} ' || n AS line FROM m""")
def q_prometheus(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = jb.prometheus(jb.request_metrics(requests(spark, sf_dir)), "requests_total", tx.escape_label)
    return got.select(F.col("place").cast("long").alias("place"), "line")


_COSTS = "SELECT CAST(user_id AS STRING) AS key, event_id AS ord, ts, CASE WHEN event_type = 'purchase' THEN 2 WHEN event_type = 'signup' THEN 4 ELSE 1 END AS cost FROM {events}"


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests of users: a purchase costs two units, a signup four (more than the limit)."""
    return made(spark, sf_dir, _COSTS).withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


@query(
    f"""WITH RECURSIVE e AS (SELECT key, ord, epoch_us(ts) / 1e6::DOUBLE AS now, cost, row_number() OVER (PARTITION BY key ORDER BY ts, ord) AS i FROM {duck(_COSTS)}),
r AS (SELECT DISTINCT key, 0::BIGINT AS i, []::DOUBLE[] AS held, NULL::BIGINT AS ord, false AS admitted, 0 AS remaining, 0 AS retry_after FROM e
UNION ALL SELECT key, i, CASE WHEN len(h) + cost <= 3 THEN list_concat(h, list_transform(range(cost), lambda x: now)) ELSE h END, ord, len(h) + cost <= 3, CASE WHEN len(h) + cost <= 3 THEN 3 - len(h) - cost ELSE 0 END::INT,
CASE WHEN len(h) + cost <= 3 THEN 0 WHEN len(h) = 0 THEN 172800 ELSE greatest(1, ceil(h[1] + 172800.0::DOUBLE - now)) END::INT FROM (SELECT e.*, list_filter(r.held, lambda x: x > e.now - 172800.0::DOUBLE) AS h FROM r JOIN e ON e.key = r.key AND e.i = r.i + 1))
SELECT key, ord, admitted, remaining, retry_after FROM r WHERE i > 0"""
)
def q_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three units in two days for each user; many requests are refused."""
    return limits.admit(costs(spark, sf_dir), 3, 172_800.0).drop("ts")


@query()
def q_rate_limit_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same units on servers of ten users each that track five at a time."""
    rows = costs(spark, sf_dir).withColumn("server", F.floor(F.col("key").cast("long") / 10))
    return limits.admit_bounded(rows, 3, 172_800.0, 5, "server")


_JOBS = """j AS (SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, o_orderdate AS created_at, o_orderdate + to_seconds((o_custkey % 90)::BIGINT) AS started_at,
o_orderdate + to_seconds((o_custkey % 90 + o_orderkey % 600)::BIGINT) AS completed_at FROM orders)"""


def orders_as_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    created = F.col("o_orderdate").cast("timestamp")
    after = lambda s: created + F.make_dt_interval(secs=s)
    status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    return o.select(F.col("o_orderkey").alias("job_id"), status.alias("status"), created.alias("created_at"), after(F.col("o_custkey") % 90).alias("started_at"), after(F.col("o_custkey") % 90 + F.col("o_orderkey") % 600).alias("completed_at"))


@query(f"WITH {_JOBS}, s AS (SELECT unnest(['uploading', 'queued', 'running', 'succeeded', 'failed', 'cancelled']) AS status) SELECT s.status, count(job_id) AS n FROM s LEFT JOIN j ON s.status = j.status GROUP BY s.status")
def q_job_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jb.snapshot(orders_as_jobs(spark, sf_dir))


@query(f"WITH {_JOBS} SELECT status, count(*) AS n, round(sum(epoch(completed_at) - epoch(started_at)), 3)::DOUBLE AS seconds FROM j WHERE status IN ('succeeded', 'failed', 'cancelled') GROUP BY status")
def q_job_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jb.durations(orders_as_jobs(spark, sf_dir)).withColumn("seconds", F.round("seconds", 3))


@query(f"WITH {_JOBS} SELECT status, count(*) AS n FROM j WHERE status IN ('succeeded', 'failed', 'cancelled') AND completed_at <= TIMESTAMP '2024-01-01 00:00:00' - INTERVAL 86400 SECOND GROUP BY status")
def q_job_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return jb.expired(orders_as_jobs(spark, sf_dir), now, 86_400).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT (o_orderkey % 12 + 1)::BIGINT AS failures, least(30 * pow(2, least(o_orderkey % 12, 7)), 3600)::DOUBLE AS delay FROM orders")
def q_retry_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 12 + 1).cast("long").alias("failures")).distinct()
    return f.select("failures", jb.retry_delay(F.col("failures")).cast("double").alias("delay"))


@query(f"WITH {_JOBS} SELECT job_id, epoch(completed_at)::BIGINT AS retry_at FROM j WHERE completed_at <= TIMESTAMP '2024-01-01 00:00:00' ORDER BY completed_at, job_id LIMIT 8")
def q_due_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = orders_as_jobs(spark, sf_dir).select("job_id", F.col("completed_at").alias("retry_at"))
    got = jb.due(entries, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return got.select("job_id", F.unix_seconds("retry_at").alias("retry_at"))


@query("SELECT event_id, user_id, sum(CASE WHEN event_type = 'signup' THEN 1 WHEN event_type = 'purchase' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS load FROM events")
def q_admission_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    change = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "purchase", -1).otherwise(0)
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_id").alias("ord"), change.alias("change"))
    return jb.running_load(e, "user_id").select("event_id", "user_id", F.col("load").cast("long").alias("load"))


_LISTING = """SELECT page_id AS ord, CASE page_id % 5 WHEN 0 THEN '.staging/' || sha2(url, 256) || '.part' WHEN 1 THEN '.staging/lock-' || CASE page_id % 4 WHEN 0 THEN '0a' WHEN 1 THEN '3f' WHEN 2 THEN '40' ELSE '1g' END WHEN 2 THEN 'a/.x.' || md5(url) || '.tmp' WHEN 3 THEN 'b/.staging/' || sha2(url, 256) || '.part' ELSE 'a/b' || page_id END AS path,
CASE page_id % 11 WHEN 0 THEN 'directory' WHEN 1 THEN 'symlink' WHEN 2 THEN 'pipe' WHEN 3 THEN NULL ELSE 'file' END AS kind, octet_length(html) AS size, CASE WHEN page_id % 13 = 0 THEN 2 ELSE 1 END AS links FROM {pages}"""
_CATEGORY = r"""CASE WHEN kind IS NULL THEN 'unreadable_entry' WHEN kind IN ('directory', 'symlink') THEN kind WHEN kind <> 'file' THEN 'special_file' WHEN links <> 1 THEN 'hardlinked_file' WHEN regexp_full_match(path, '\.staging/[0-9a-f]{64}\.part') THEN 'recoverable_stage_candidate'
WHEN regexp_full_match(path, '\.staging/lock-[0-3][0-9a-f]') THEN 'coordination_lock_candidate' WHEN regexp_full_match(path, '(.*/)?\.[^/]+\.[0-9a-f]{32}\.tmp') THEN 'legacy_temporary_candidate' ELSE 'other_regular_file' END"""
_LISTED = duck(_LISTING).replace("sha2(url, 256)", "sha256(url)").replace("octet_length(html)", "strlen(html)")


@query(f"WITH c AS (SELECT unnest({list(CATEGORIES)}) AS category), l AS (SELECT *, {_CATEGORY} AS category FROM {_LISTED}) SELECT c.category, count(l.ord) AS n, coalesce(sum(CASE WHEN kind = 'file' THEN size END), 0)::BIGINT AS bytes FROM c LEFT JOIN l ON l.category = c.category GROUP BY c.category")
def q_inventory_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as entries of a storage folder: count and bytes of all nine categories."""
    return inventory(made(spark, sf_dir, _LISTING), most_entries=1 << 30)[0]


@query(f"SELECT sha256(path) AS path_id, {_CATEGORY} AS category, CASE WHEN kind = 'file' THEN size END AS size, links FROM (SELECT * FROM {_LISTED} ORDER BY ord LIMIT 25)")
def q_inventory_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The details that a report shows: its first 25 entries."""
    return inventory(made(spark, sf_dir, _LISTING), most_items=25)[1]


@query(
    """WITH d AS (SELECT doc_id, greatest(1, n_chars // 500)::INT AS n FROM documents) SELECT doc_id, CASE WHEN n <= 3 THEN array_to_string(range(1, n + 1), ',') ELSE '1,' || ((n + 1) // 2) || ',' || n END AS sampled FROM d"""
)
def q_page_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First, middle and last page of three or more; the table's 500 characters make a page."""
    n = F.greatest(F.lit(1), F.floor(F.col("n_chars") / 500)).cast("int")
    picks = F.when(n <= 3, F.sequence(F.lit(1), n)).otherwise(F.array(F.lit(1), F.floor((n + 1) / 2).cast("int"), n))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(picks, ",").alias("sampled"))


_LAYERS = "SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN substr(text, 1, 20) WHEN 2 THEN substr(text, 1, CAST(floor(length(text) / 3) AS INT)) WHEN 3 THEN repeat('\u0416\u0434 \u05d0', 60) ELSE text END AS native, CASE doc_id % 5 WHEN 0 THEN repeat('\u0e81\u0e82 ', 40) WHEN 1 THEN text || text ELSE text END AS ocr FROM {documents} WHERE text IS NOT NULL"
_COUNTS = r"length(regexp_replace({0}, '[\s\x{{0085}}\x{{00A0}}]+', '', 'g')) AS {1}s, len(regexp_extract_all({0}, '[\x{{0E80}}-\x{{0EFF}}]')) AS {1}l, len(regexp_extract_all({0}, '\p{{Latin}}')) AS {1}a, len(regexp_extract_all(regexp_replace({0}, '[\x{{0E80}}-\x{{0EFF}}\p{{Latin}}]', '', 'g'), '\p{{L}}')) AS {1}o"


@query(
    f"""WITH c AS (SELECT doc_id, {_COUNTS.format('native', 'n')}, {_COUNTS.format('ocr', 'r')} FROM {duck(_LAYERS)}) SELECT doc_id, CASE WHEN ns = 0 AND rs > 0 THEN 'native-layer-empty' WHEN ns <= 32 AND rs >= greatest(100, ns * 5) THEN 'native-layer-sparse'
WHEN ns >= 100 AND no >= greatest(20, floor((nl + na + no) * 0.15)) AND ro <= greatest(5, floor(no * 0.1)) AND rl + ra >= 50 THEN 'native-layer-script-anomaly' WHEN rl >= 50 AND nl < greatest(5, floor(rl * 0.1)) THEN 'lao-missing-from-native-layer'
WHEN ns > 0 AND rs >= ns * 2 THEN 'ocr-much-richer-than-native' ELSE 'no-large-gap-detected' END AS gap FROM c"""
)
def q_layer_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the two layers of a page, one of them emptied, shortened, doubled or in another script."""
    gap = ro.layer_gap(tx.layer_counts(F.col("native")), tx.layer_counts(F.col("ocr")))
    return made(spark, sf_dir, _LAYERS).select("doc_id", gap.alias("gap"))


@query("SELECT CASE WHEN value IS NULL THEN 'no-confidence' WHEN value / 100 < 0.6 THEN 'low' WHEN value / 100 < 0.8 THEN 'medium' ELSE 'high' END AS band, count(*) AS n FROM events GROUP BY 1")
def q_conf_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(ro.confidence_band(F.col("value") / 100).alias("band")).agg(F.count("*").alias("n"))


@query("SELECT epoch(time_bucket(INTERVAL 60 MINUTE, ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def q_events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return jb.tumbling(e, 60).select(F.unix_seconds("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    """WITH g AS (SELECT user_id, ts, (coalesce(ts >= lag(ts) OVER w + INTERVAL 120 MINUTE, true))::INT AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last, count(*) AS n FROM s GROUP BY user_id, k"""
)
def q_events_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return jb.sessions(e, 120).select("user_id", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"), "n")


def _stage_succeeds(job: str, stage: str, failures: int) -> bool:
    """A store that fails some stages up to three times."""
    return failures >= zlib.crc32(f"{job} {stage}".encode()) % 4


@query()
def q_cleanup_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expiry, tries and retries of purchases as finished jobs, a user as a manager, up to a day after the last event."""
    events = table(spark, sf_dir, "events")
    last = events.agg((F.max(F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6).alias("t")).first()["t"] or 0.0
    ended = events.select(F.col("user_id").cast("string").alias("manager"), F.col("event_id").cast("string").alias("job_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ended_at"))
    acts = cl.cleanup(ended, last + 86400, _stage_succeeds, retention=3600, delay=60)
    return acts.select("manager", "job_id", "act", "failures", "artifact", "workspace", F.col("at").cast("long").alias("at"), F.col("retry_at").cast("long").alias("retry_at"))


@query()
def q_cleanup_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's cleanup an hour and two minutes after the last event, when its latest jobs have just expired and some still wait."""
    events = table(spark, sf_dir, "events")
    ts = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    last = events.agg(F.max(ts).alias("t")).first()["t"] or 0.0
    ended = events.select(F.col("user_id").cast("string").alias("manager"), F.col("event_id").cast("string").alias("job_id"), ts.alias("ended_at"))
    return cl.figures(cl.cleanup(ended, last + 3720, _stage_succeeds, retention=3600, delay=60))
