"""Queries over the operators of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillforge.llm import licenses, middle, topk, variants
from quillforge.llm.media import media_digest
from quillforge.llm.mixing import mix_query
from quillforge.llm.nearest import nearest_query
from quillforge.llm.neardup import near_duplicates
from quillforge.llm.packing import packing_query
from quillforge.llm.quality import quality_query
from quillforge.llm.spans import spans_query
from quillforge.llm.tokenfile import tokens_query
from quillforge.llm.windows import windows_query
from quillforge.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _documents(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_genetic_packing": _documents(packing_query),
    "op2_vantage_nearest": lambda spark, sf_dir: nearest_query(table(spark, sf_dir, "embeddings")),
    "op3_rare_token_licenses": _documents(licenses.licenses_query),
    "op4_countmin_windows": _documents(windows_query),
    "op5_ogg_media": _documents(media_digest),
    "op6_addressable_tokens": lambda spark, sf_dir: tokens_query(spark, table(spark, sf_dir, "documents")),
    "op7_hyperminhash": _documents(near_duplicates),
    "op8_budget_mix": _documents(mix_query),
    "op9_quality": lambda spark, sf_dir: quality_query(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op10_suffix_spans": _documents(spans_query),
    "op11_segment_automata": _documents(variants.variants_query),
    "op12_term_at_a_time": lambda spark, sf_dir: topk.topk_query(table(spark, sf_dir, "embeddings")),
    "op13_relational_middle": _documents(middle.middle_query),
}

ORACLES: dict[str, str] = {
    "op11_segment_automata": variants.oracle(),
    "op12_term_at_a_time": topk.ORACLE,
    "op13_relational_middle": middle.ORACLE,
    "op3_rare_token_licenses": licenses.oracle(),
    "op4_countmin_windows": r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), places AS (
  SELECT doc_id, words, unnest(range(1, greatest(len(words) - 18, 1))) AS i FROM docs
), ranked AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(words[i:i + 19], ' ') ORDER BY doc_id, i) AS nth FROM places
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM ranked WHERE nth > 1
), each AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM docs
), kept AS (
  SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.p) AS kept, count(*) AS n
  FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p WHERE g.p IS NULL GROUP BY e.doc_id
)
SELECT d.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id
""",
}
