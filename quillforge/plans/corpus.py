"""Corpus queries: scanning, normalizing, preparing, splitting, counting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillforge.functions import hashing as hs
from quillforge.functions import text as tx
from quillforge.operators import corpus as cp
from quillforge.operators.linked import settled
from quillforge.plans.registry import query
from quillforge.tables import table

_LINES = r"""
SELECT doc_id, lang, source, unnest(parts) AS line, unnest(range(len(parts))) AS pos
FROM (SELECT doc_id, lang, source, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS parts FROM documents WHERE text <> '')
"""
_TIDY = r"trim(regexp_replace({0}, '[\t\x{{00A0}} ]+', ' ', 'g'))"
_RATIO = r"CASE WHEN len(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]')) = 0 THEN 0 ELSE len(regexp_extract_all({0}, '[A-Za-z]')) / len(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]'))::DOUBLE END"
_PREPARED = f"""
WITH l AS ({_LINES}), c AS (SELECT doc_id, lang, source, pos, {_TIDY.format("nfc_normalize(line)")} AS t FROM l),
ok AS (SELECT *, {_RATIO.format("t")} AS r FROM c WHERE length(t) BETWEEN 8 AND 180),
kept AS (SELECT * FROM ok WHERE r >= 0.5 QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id, pos) = 1)
"""
_FRACTION = "(('0x' || substr(sha256({0}), 1, 15))::BIGINT * 16.0::DOUBLE + ('0x' || substr(sha256({0}), 16, 1))::BIGINT) / 18446744073709551616.0"
_SPLIT = f"CASE WHEN {_FRACTION} < 0.8 THEN 'train' WHEN {_FRACTION} < 0.9 THEN 'development' ELSE 'test' END"
_SLOT = "('0x' || substr(sha256({0}), 1, 8))::BIGINT % 10000"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(f"SELECT source, count(*) AS n_lines, count(*) FILTER (WHERE trim(line) <> '') AS n_text_lines, sum(length(line))::BIGINT AS n_chars FROM ({_LINES}) GROUP BY source")
def q_lines_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cp.lines(_documents(spark, sf_dir))
    return rows.groupBy("source").agg(F.count("*").alias("n_lines"), F.count_if(F.trim("line") != "").alias("n_text_lines"), F.sum(F.char_length("line")).alias("n_chars"))


@query(
    r"""SELECT doc_id, sha256(t) AS normal_sha256, length(t) AS n_chars FROM (
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '\r\n?', chr(10), 'g'), '[\t\x{00A0} ]+', ' ', 'g'), '(?m)^ +| +$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM documents WHERE text IS NOT NULL)"""
)
def q_text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _documents(spark, sf_dir).where("text is not null").select("doc_id", tx.normalize_text(F.col("text")).alias("t"))
    return t.select("doc_id", F.sha2("t", 256).alias("normal_sha256"), F.char_length("t").cast("long").alias("n_chars"))


@query(f"SELECT doc_id, round({_RATIO.format('text')}, 6) AS ratio FROM documents WHERE text IS NOT NULL")
def q_script_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).where("text is not null").select("doc_id", F.round(tx.script_ratio(F.col("text"), tx.LATIN), 6).alias("ratio"))


@query(f"{_PREPARED} SELECT lang, count(*) AS kept_lines, sum(length(t))::BIGINT AS kept_chars, count(DISTINCT source) AS n_sources FROM kept GROUP BY lang")
def q_corpus_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cp.lines(_documents(spark, sf_dir)).select("doc_id", "lang", "source", "pos", "line")
    kept = cp.prepare(rows, tx.LATIN)
    return kept.groupBy("lang").agg(F.count("*").alias("kept_lines"), F.sum(F.char_length("line")).alias("kept_chars"), F.countDistinct("source").alias("n_sources"))


@query(f"{_PREPARED} SELECT doc_id, pos, t AS line FROM kept ORDER BY doc_id, pos LIMIT 500")
def q_corpus_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cp.lines(_documents(spark, sf_dir)).select("doc_id", F.col("pos").cast("long").alias("pos"), "line")
    return cp.prepare(rows, tx.LATIN, limit=500)


@query(
    r"""SELECT doc_id, length(text) AS n_chars, len(regexp_extract_all(text, '[^\s\x{0085}\x{00A0}]')) AS n_solid, len(regexp_extract_all(text, '[^\s]+')) AS n_words,
CASE WHEN text = '' THEN 0 ELSE len(string_split(regexp_replace(text, '\n$', ''), chr(10))) END AS n_lines, len(regexp_extract_all(text, '[A-Za-z]')) AS n_script,
len(regexp_extract_all(text, '\p{L}')) AS n_letters, len(regexp_extract_all(text, '\p{M}')) AS n_marks, len(regexp_extract_all(text, '\p{Nd}')) AS n_digits,
len(regexp_extract_all(text, '[\p{P}\p{S}]')) AS n_punct, len(regexp_extract_all(text, '\x{FFFD}')) AS n_replaced FROM documents WHERE text IS NOT NULL"""
)
def q_text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = tx.text_stats(F.col("text"), tx.LATIN)
    return _documents(spark, sf_dir).where("text is not null").select("doc_id", *(c.alias(n) for n, c in stats.items()))


@query()
def q_bounded_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cp.lines(_documents(spark, sf_dir)).select("doc_id", "pos", tx.normalize_line(F.col("line")).alias("line"))
    return cp.bounded_sample(rows.where(tx.eligible(F.col("line"), tx.LATIN)), limit=2000, per_document=3)


@query("SELECT char, row_number() OVER (ORDER BY encode(char)) AS id FROM (SELECT DISTINCT unnest(string_split(nfc_normalize(text), '')) AS char FROM benchmark) WHERE char NOT IN ('', chr(10), chr(13))")
def q_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.vocabulary(table(spark, sf_dir, "benchmark").select(tx.nfc(F.col("text")).alias("text")), "text")


@query(
    """WITH v AS (SELECT DISTINCT unnest(string_split(text, '')) AS char FROM benchmark), c AS (SELECT DISTINCT doc_id, unnest(string_split(text, '')) AS char FROM documents)
SELECT char, count(*) AS n_rows FROM c WHERE char NOT IN (SELECT char FROM v) AND char <> '' GROUP BY char"""
)
def q_vocab_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = cp.characters(table(spark, sf_dir, "benchmark"), "text").select("char").distinct()
    return cp.missing_characters(_documents(spark, sf_dir), "text", "doc_id", vocab)


@query(f"SELECT doc_id, {_SPLIT.format('doc_id::VARCHAR')} AS split FROM documents")
def q_stable_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", hs.stable_split(F.col("doc_id").cast("string")).alias("split"))


@query(
    f"""WITH g AS (SELECT source, count(*) AS n, {_SLOT.format('source')} AS slot, sha256(source) AS h FROM documents GROUP BY source),
s AS (SELECT *, slot < 1000 AS dev, bool_and(slot < 1000) OVER () AS all_dev, bool_or(slot < 1000) OVER () AS any_dev, max(h) OVER () AS hi, min(h) OVER () AS lo FROM g)
SELECT source, n, CASE WHEN NOT any_dev AND h = hi THEN 'development' WHEN all_dev AND h = lo THEN 'train' WHEN dev THEN 'development' ELSE 'train' END AS split FROM s"""
)
def q_group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole groups by hash; if one side would be empty, the group at the end of hash order changes sides."""
    groups = _documents(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n")).withColumn("h", F.sha2("source", 256)).withColumn("dev", hs.group_slot(F.col("source")) < 1000)
    ends = groups.agg(F.bool_and("dev").alias("all_dev"), F.bool_or("dev").alias("any_dev"), F.max("h").alias("hi"), F.min("h").alias("lo"))
    one = groups.join(F.broadcast(ends), F.lit(True))  # one row of four values
    split = F.when(~F.col("any_dev") & (F.col("h") == F.col("hi")), "development").when(F.col("all_dev") & (F.col("h") == F.col("lo")), "train")
    return one.select("source", "n", split.when(F.col("dev"), "development").otherwise("train").alias("split"))


@query(
    f"""SELECT source, string_agg(DISTINCT split, ',' ORDER BY split) AS splits, count(DISTINCT split) AS n_splits
FROM (SELECT source, {_SPLIT.format('doc_id::VARCHAR')} AS split FROM documents) GROUP BY source HAVING count(DISTINCT split) > 1"""
)
def q_split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups whose documents fall into several splits."""
    split = hs.stable_split(F.col("doc_id").cast("string")).alias("split")
    sets = _documents(spark, sf_dir).select("source", split).groupBy("source").agg(F.array_sort(F.collect_set("split")).alias("s"))
    return sets.where(F.size("s") > 1).select("source", F.array_join("s", ",").alias("splits"), F.size("s").cast("long").alias("n_splits"))


@query("SELECT sha256(text) AS text_sha256, count(*) AS n_rows, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT doc_id) > 1")
def q_duplicate_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = _documents(spark, sf_dir).where("text is not null").groupBy(F.sha2("text", 256).alias("text_sha256"))
    found = groups.agg(F.count("*").alias("n_rows"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    return found.where("first_doc <> last_doc")


@query(
    """SELECT item_id // 16 AS part, count(*) AS n_texts, sha256(unhex(string_agg(lpad(hex(strlen(text)), 16, '0') || hex(encode(text)), '' ORDER BY encode(text)))) AS fingerprint
FROM (SELECT DISTINCT item_id // 16 * 16 AS item_id, text FROM benchmark) GROUP BY 1"""
)
def q_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select(F.floor(F.col("item_id") / 16).alias("part"), "text").distinct()
    return rows.groupBy("part").agg(F.count("*").alias("n_texts"), F.collect_list("text").alias("t")).select("part", "n_texts", hs.set_fingerprint(F.col("t")).alias("fingerprint"))


@query(
    f"""WITH l AS ({_LINES}), b AS (SELECT DISTINCT {_TIDY.format("unnest(string_split(text, chr(10)))")} AS t FROM benchmark)
SELECT lang, count(*) FILTER (WHERE t NOT IN (SELECT t FROM b)) AS kept, count(*) FILTER (WHERE t IN (SELECT t FROM b)) AS excluded
FROM (SELECT lang, {_TIDY.format("line")} AS t FROM l) GROUP BY lang"""
)
def q_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that equal a benchmark line after normalization, and the others."""
    rows = cp.lines(_documents(spark, sf_dir)).select("lang", "doc_id", "pos", tx.normalize_line(F.col("line")).alias("t"))
    bench = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "\n")).alias("t")).select(tx.normalize_line(F.col("t")).alias("t")).distinct().withColumn("hit", F.lit(True))
    if bench.count() <= 100_000:  # lines of the benchmark; beyond that equal lines are counted first, so no line is a hot key
        counted, bench = rows.withColumn("n", F.lit(1).cast("long")), F.broadcast(bench)
    else:
        counted = rows.groupBy("lang", "t").agg(F.count("*").alias("n"))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    marked = counted.join(bench, "t", "left")
    return marked.groupBy("lang").agg(total(F.col("hit").isNull()).alias("kept"), total(F.col("hit").isNotNull()).alias("excluded"))


_NGRAMS = """
e AS (SELECT item_id, chr(1) || chr(1) || text AS p, unnest(range(length(text))) AS i FROM benchmark),
s AS (SELECT item_id, p, i, substr(p, i::INT + 3, 1) AS token, unnest([0, 1, 2]) AS len FROM e),
n AS (SELECT item_id, i, len, substr(p, i::INT + 3 - len, len) AS context, token FROM s)
"""


@query(f"WITH {_NGRAMS} SELECT len, context, token, count(*) AS n FROM n GROUP BY ALL")
def q_ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.ngram_counts(table(spark, sf_dir, "benchmark"), "text", 3)


def _model_sql(order: int) -> str:
    """A model of all documents scores every benchmark item (an alphabet of 200). Characters before one are looked up by window, so texts of any length take linear time."""
    lags = ", ".join(f"lag(token, {k}, chr(1)) OVER w AS b{k}" for k in range(1, order))
    contexts = ", ".join(f"{{'len': {n}, 'context': {' || '.join(f'b{k}' for k in range(n, 0, -1)) or repr('')}}}" for n in range(order))
    grams = lambda key, rows: f"(SELECT {key}, i, token, unnest([{contexts}], recursive := true) FROM (SELECT {key}, i, token, {lags} FROM (SELECT {key}, unnest(c) AS token, generate_subscripts(c, 1) AS i FROM (SELECT {key}, string_split(text, '') AS c FROM {rows} WHERE text <> '')) WINDOW w AS (PARTITION BY {key} ORDER BY i)))"
    return f"""WITH c AS (SELECT len, context, token, count(*) AS n FROM {grams('doc_id', 'documents')} GROUP BY ALL), x AS {grams('item_id', 'benchmark')}, t AS (SELECT len, context, sum(n) AS total FROM c GROUP BY ALL),
p AS (SELECT x.item_id, x.i, x.len, t.total, coalesce(c.n, 0) AS n FROM x JOIN t USING (len, context) LEFT JOIN c ON c.len = x.len AND c.context = x.context AND c.token = x.token),
best AS (SELECT item_id, i, arg_max(n, len) AS n, arg_max(total, len) AS total FROM p GROUP BY item_id, i)
SELECT item_id, round(sum(ln((n + 0.1::DOUBLE) / (total + 0.1::DOUBLE * 200))), 4) AS log_prob, count(*) AS n_chars FROM best GROUP BY item_id"""


def _model_score(spark: SparkSession, sf_dir: str, order: int) -> DataFrame:
    model = cp.packed_grams(_documents(spark, sf_dir), "text", order)
    got = cp.model_scores(table(spark, sf_dir, "benchmark"), "text", "item_id", settled(model), order, 200)
    return got.select("item_id", F.round("log_prob", 4).alias("log_prob"), "n_chars")


@query(_model_sql(3))
def q_ngram_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model_score(spark, sf_dir, 3)


@query(_model_sql(6))
def q_ngram_score_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of up to five characters, which fall back to shorter ones."""
    return _model_score(spark, sf_dir, 6)


@query(
    """SELECT char, row_number() OVER (ORDER BY encode(char)) AS id FROM (SELECT DISTINCT unnest(string_split(nfc_normalize(text), '')) AS char FROM documents) WHERE char NOT IN ('', chr(10), chr(13))"""
)
def q_corpus_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary of all documents."""
    return cp.corpus_vocabulary(_documents(spark, sf_dir), "text")


@query()
def q_corpus_ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language model of all documents, whole."""
    return cp.corpus_ngram_counts(_documents(spark, sf_dir), "text", 3)


@query()
def q_corpus_ngram_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under the model of all documents (an alphabet of 200)."""
    got = cp.corpus_scores(_documents(spark, sf_dir), "text", "doc_id", 200)
    return got.select("doc_id", F.round("log_prob", 4).alias("log_prob"), "n_chars")
