"""From raw documents to packed training sequences: five stages, each over all that the one before kept.

A stage is called with (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillforge.llm.mixing import mix
from quillforge.llm.neardup import near_duplicates
from quillforge.llm.packing import pack, pieces
from quillforge.llm.quality import fit, quality_scores
from quillforge.llm.spans import cut_spans
from quillforge.llm.stages import remove, shared_folder
from quillforge.tables import table

#: A document goes only if its probability of label 1 is below this.
REJECT_BELOW = 0.3
SHINGLE, PERCENT = 5, 80


def _slim(docs: DataFrame, *needed: str) -> DataFrame:
    """``needed`` and one struct of all other columns, so that no operator meets their names."""
    rest = [c for c in docs.columns if c not in needed]
    return docs.select(*needed, F.struct(F.lit(0).alias("none"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest))).alias("rest"))


def _whole(slim: DataFrame, docs: DataFrame, *needed: str) -> DataFrame:
    """The columns of ``docs`` back from ``_slim``."""
    rest = [c for c in docs.columns if c not in needed]
    return slim.select(*(F.col(c) if c in needed else F.col(f"rest.c{rest.index(c)}").alias(c) for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    Null and empty texts are scored like others; repeated rows share their fate; ties don't arise. Columns may have any
    names and all stay. With no labels nothing is rejected. An empty table gives no rows.
    """
    model = fit(docs, table(spark, sf_dir, "labels"))
    slim = _slim(docs, "doc_id", "text")
    scored = quality_scores(spark, slim, model, slim.columns).where(F.col("score") >= REJECT_BELOW)
    return _whole(scored, docs, "doc_id", "text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): the smallest doc_id.

    Rows that share a doc_id are one document: the row with the smallest hash of its text stays, of equal texts any one.
    Rows without an id and documents without words stay. Columns may have any names. An empty table gives no rows.
    """
    slim = _slim(docs, "doc_id", "text")
    found = near_duplicates(slim, SHINGLE, PERCENT)
    left = slim.join(found.where(~F.col("kept")).select("doc_id").distinct(), "doc_id", "left_anti")
    twice = found.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if not twice.isEmpty():
        place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))
        left = left.withColumn("place", place).where((F.col("place") == 1) | F.col("doc_id").isNull())
    return _whole(left, docs, "doc_id", "text")


def span_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of any 200-byte string that starts twice or more.

    A character that is cut in two reads U+FFFD. Documents of which nothing is left go; those that were empty or null
    stay. Repeated rows of 200 bytes or more remove each other. n_chars, where there is one, follows a text that was
    cut; other columns, of any names, stay as they are. An empty table gives no rows.
    """
    cut = cut_spans(_slim(docs, "doc_id", "text"))
    cut = cut.where(~((F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n_bytes"))))
    text = F.when(F.col("n_removed") > 0, F.make_valid_utf8(F.col("kept").cast("string"))).otherwise(F.col("text"))
    cut = cut.withColumn("text", text)
    if "n_chars" in docs.columns:
        old = f"rest.c{[c for c in docs.columns if c not in ('doc_id', 'text')].index('n_chars')}"
        length = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col(old)).cast(docs.schema["n_chars"].dataType)
        cut = cut.withColumn("rest", F.col("rest").withField(old.removeprefix("rest."), length))
    return _whole(cut, docs, "doc_id", "text")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them: none to three rows each.

    Null texts have size 0, a null source is a source of its own, repeated rows are taken one by one, ties in size go by
    a seeded hash. Columns may have any names. An empty table gives no rows.
    """
    taken = mix(docs).where("repeats > 0")
    copies = taken.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats"))))
    return copies.select(*(F.col(f"doc.`{c}`") for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 1024 tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece, its end mark. Repeated rows (the mixture makes them) are packed one by one. Other
    columns, of any names, don't matter. An empty table gives no rows.
    """
    return pack(pieces(docs, "byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("span_dedup", span_dedup),
    ("mixture", mixture),
    ("packing", packing),
]

#: SQL can't express the classifier, so run() is tested against brute-force versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage's result is written to the shared folder and read again.

    A stage's folder goes when the next one is written; the last one stays, for the result reads it.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
