"""Readers that keep bad rows as violations in place of failing at the first one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A manifest line; what isn't there reads null.
MANIFEST = "id string, document_id string, split string, subset string, source string, ground_truth string, language string, license string, provenance string, sha256 string, notes string, tags array<string>, review struct<status:string,reviewer:string,reviewed_at:string,notes:string>"


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, pos and line of text files, numbered within each file."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return whole.select("file", F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n", -1)).alias("pos", "line"))


def jsonl_texts(spark: SparkSession, path: str, field: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts, violations) of JSONL files: one string field of each object; blank lines are skipped."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    value = F.try_parse_json("value")
    kind = F.schema_of_variant(F.try_variant_get(value, f"$.{field}", "variant"))
    rows = raw.select("value", value.alias("v"), kind.alias("kind"))
    problem = F.when(F.col("v").isNull(), "not JSON").when(~F.schema_of_variant("v").startswith("OBJECT"), "not an object").when(F.coalesce(F.col("kind"), F.lit("")) != "STRING", "no text")
    good = rows.where(problem.isNull()).select(F.try_variant_get("v", f"$.{field}", "string").alias(field))
    return good, rows.where(problem.isNotNull()).select("value", problem.alias("problem"))


def manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(samples, violations) of a JSONL manifest; # starts a comment line."""
    raw = spark.read.text(path).where((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    rows = raw.select("value", F.from_json("value", MANIFEST + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("s"))
    missing = F.coalesce(F.col("s._bad"), F.when(F.col("s.id").isNull() | F.col("s.document_id").isNull(), F.lit("missing field")))
    return rows.where(missing.isNull()).select("s.*").drop("_bad"), rows.where(missing.isNotNull()).select("value", F.lit("bad line").alias("problem"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"), file_kind(F.col("content")).alias("kind"))


def file_kind(content: Column) -> Column:
    """Format by first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    starts = lambda hexed: head.startswith(hexed)
    return F.when(starts("25504446"), "pdf").when(starts("89504E470D0A1A0A"), "png").when(starts("FFD8FF"), "jpeg").when(starts("49492A00") | starts("4D4D002A"), "tiff").when(starts("504B0304"), "zip").otherwise("unknown")


def review_decisions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(decisions, violations) of a CSV with id, status, reviewer and notes; rows without a status are skipped."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "status", "reviewer", "notes")])
    rows = spark.read.csv(path, header=True, schema=schema, enforceSchema=False).where(F.trim(F.coalesce("status", F.lit(""))) != "")
    twice = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("decided twice").alias("problem"))
    odd = rows.where(~F.col("status").isin("approved", "rejected", "pending")).select("id", F.lit("unknown status").alias("problem"))
    return rows, twice.unionByName(odd)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """digest, name and problem of lines like sha256sum writes."""
    rows = spark.read.text(path).select(F.regexp_extract("value", r"^([0-9a-fA-F]{64})  ?\*?(.+)$", 1).alias("digest"), F.regexp_extract("value", r"^([0-9a-fA-F]{64})  ?\*?(.+)$", 2).alias("name"))
    return rows.withColumn("problem", F.when(F.col("digest") == "", "bad line").when(F.col("name").rlike(r"(^/|(^|/)\.\.(/|$))"), "unsafe path"))
