"""SQL functions, registered once a session. All but beam search are SQL that Catalyst inlines, without Python at run time."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quillforge.functions.text import LAO
from quillforge.operators.ctc import beam_decode

FUNCTIONS = {
    "script_ratio": rf"(t STRING) RETURNS DOUBLE RETURN CASE WHEN regexp_count(t, r'[\p{{L}}\p{{N}}_{LAO}]') = 0 THEN 0D ELSE regexp_count(t, r'[{LAO}]') / regexp_count(t, r'[\p{{L}}\p{{N}}_{LAO}]') END",
    "cer": "(r STRING, h STRING) RETURNS DOUBLE RETURN CASE WHEN r = '' THEN CASE WHEN h = '' THEN 0D ELSE 1D END ELSE levenshtein(r, h) / CAST(char_length(r) AS DOUBLE) END",
    "stable_split": "(k STRING) RETURNS STRING RETURN CASE WHEN CAST(conv(substr(sha2(k, 256), 1, 16), 16, 10) AS DOUBLE) / 18446744073709551616D < 0.8D THEN 'train' WHEN CAST(conv(substr(sha2(k, 256), 1, 16), 16, 10) AS DOUBLE) / 18446744073709551616D < 0.9D THEN 'development' ELSE 'test' END",
    "box_iou": "(ax DOUBLE, ay DOUBLE, aw DOUBLE, ah DOUBLE, bx DOUBLE, by_ DOUBLE, bw DOUBLE, bh DOUBLE) RETURNS DOUBLE RETURN coalesce(try_divide(greatest(0D, least(ax + aw, bx + bw) - greatest(ax, bx)) * greatest(0D, least(ay + ah, by_ + bh) - greatest(ay, by_)), aw * ah + bw * bh - greatest(0D, least(ax + aw, bx + bw) - greatest(ax, bx)) * greatest(0D, least(ay + ah, by_ + bh) - greatest(ay, by_))), 0D)",
    "text_normalize": r"(t STRING) RETURNS STRING RETURN regexp_replace(regexp_replace(array_join(transform(split(regexp_replace(regexp_replace(t, '\r\n?', '\n'), r'[\t\x{00A0} ]+', ' '), '\n', -1), line -> trim(line)), '\n'), '\n{3,}', '\n\n'), r'(?U)^\s+|\s+$', '')",
    "wer": r"(r STRING, h STRING) RETURNS DOUBLE RETURN CASE WHEN regexp_count(r, r'(?U)\S+') = 0 THEN CASE WHEN regexp_count(h, r'(?U)\S+') = 0 THEN 0D ELSE 1D END ELSE levenshtein(array_join(transform(filter(split(r, r'(?U)\s+'), w -> w <> ''), w -> decode(unhex(lpad(hex(65536 + array_position(array_distinct(concat(split(r, r'(?U)\s+'), split(h, r'(?U)\s+'))), w)), 8, '0')), 'UTF-32')), ''), array_join(transform(filter(split(h, r'(?U)\s+'), w -> w <> ''), w -> decode(unhex(lpad(hex(65536 + array_position(array_distinct(concat(split(r, r'(?U)\s+'), split(h, r'(?U)\s+'))), w)), 8, '0')), 'UTF-32')), '')) / CAST(regexp_count(r, r'(?U)\S+') AS DOUBLE) END",
    "text_stats": rf"(t STRING) RETURNS STRUCT<n_chars: BIGINT, n_solid: BIGINT, n_words: BIGINT, n_script: BIGINT> RETURN named_struct('n_chars', CAST(char_length(t) AS BIGINT), 'n_solid', CAST(char_length(regexp_replace(t, r'[\s\x{{0085}}\x{{00A0}}]+', '')) AS BIGINT), 'n_words', CAST(regexp_count(t, r'(?U)\S+') AS BIGINT), 'n_script', CAST(regexp_count(t, r'[{LAO}]') AS BIGINT))",
    "frame_fingerprint": "(ts ARRAY<STRING>) RETURNS STRING RETURN sha2(aggregate(array_sort(array_distinct(ts)), X'', (acc, t) -> concat(acc, unhex(lpad(hex(octet_length(t)), 16, '0')), encode(t, 'UTF-8'))), 256)",
}


def register(spark: SparkSession) -> None:
    """Register all functions: SQL ones, and ctc_beam_decode(array<array<double>>), the one that runs in Python.

    text_normalize composes nothing: texts in another form than NFC go through ``text.nfc`` first.
    """
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    spark.udf.register("ctc_beam_decode", beam_decode())
