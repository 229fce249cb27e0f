"""Typed scans of manifests, reports, suites and listings. Each returns (rows, violations): what breaks a rule is named, not raised.

Manifests are JSONL: blank lines and lines that start with # don't count. Line numbers restart with each file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillforge.functions import text as tx
from quillforge.functions.hashing import is_sha256
from quillforge.sources.readers import text_lines

SAFE_ID = r"^[A-Za-z0-9][A-Za-z0-9._-]*\z"

#: What the typed manifests hold.
DATASET = "id string, document_id string, split string, subset string, source string, ground_truth string, layout_ground_truth string, language string, license string, provenance string, sha256 string, notes string, tags array<string>, review struct<status:string,reviewer:string,reviewed_at:string,notes:string>"
TRAINING = "id string, image string, text string, sha256 string"
LAYOUT_TRAINING = "id string, document_id string, image string, layout_ground_truth string, split string, subset string, tags array<string>, sha256 string, width int, height int, block_counts map<string,int>"
LAYOUT_TARGETS = "id string, image string, mask string, split string, subset string, tags array<string>"


def _entries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    lines = text_lines(spark, path).select("file", (F.col("pos") + 1).alias("line_number"), F.trim("line").alias("line"))
    body = lines.where((F.col("line") != "") & ~F.col("line").startswith("#"))
    return body.withColumn("e", F.from_json("line", schema + ", __bad string", {"columnNameOfCorruptRecord": "__bad"}))


def _checked(rows: DataFrame, rules: list[tuple[str, Column]], key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Entries without a problem, and (line_number, id, problem) of the others; a key that occurs again is a problem of all but the first.

    Two scans that hold no rows at all give the violation "no entries".
    """
    broken = [("bad line", F.col("e.__bad").isNotNull() | F.col("e").isNull()), *((n, F.col("e").isNotNull() & F.col("e.__bad").isNull() & F.coalesce(bad, F.lit(True))) for n, bad in rules)]
    again = F.row_number().over(Window.partitionBy(F.col(f"e.{key}")).orderBy("file", "line_number")) > 1
    judged = rows.withColumn("again", again & F.col(f"e.{key}").isNotNull() & F.col("e.__bad").isNull()).withColumn("problems", F.array_compact(F.array(*(F.when(bad, F.lit(n)) for n, bad in broken), F.when(F.col("again"), f"duplicate {key}"))))
    good = judged.where(F.size("problems") == 0).select("line_number", "e.*").drop("__bad")
    bad = judged.where(F.size("problems") > 0).select("line_number", F.col(f"e.{key}").alias("id"), F.explode("problems").alias("problem"))
    none = rows.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(None).cast("int").alias("line_number"), F.lit(None).cast("string").alias("id"), F.lit("no entries").alias("problem"))
    return good, bad.unionByName(none)


def _empty(name: str) -> Column:
    return F.coalesce(F.col(f"e.{name}"), F.lit("")) == ""


def _unsafe(name: str) -> Column:
    return ~tx.safe_relative(F.coalesce(F.col(f"e.{name}"), F.lit("")))


def dataset_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Samples: id, document_id, split, subset, source and ground_truth are needed; ids are unique; hashes, where given, are SHA-256."""
    rules = [(f"no {c}", _empty(c)) for c in ("id", "document_id", "split", "subset", "source", "ground_truth")]
    rules.append(("bad sha256", F.col("e.sha256").isNotNull() & ~is_sha256(F.col("e.sha256"))))
    return _checked(_entries(spark, path, DATASET), rules)


def training_manifest(spark: SparkSession, path: str, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Samples: id, image and text are needed. With ``files`` (path relative to the manifest, sha256) images must be there and, where a hash is pinned, hold that content."""
    good, bad = _checked(_entries(spark, path, TRAINING), [(f"no {c}", _empty(c)) for c in ("id", "image", "text")])
    if files is None:
        return good, bad
    both = good.join(files.select(F.col("path").alias("image"), F.col("sha256").alias("__actual")), "image", "left")
    problem = F.when(F.col("__actual").isNull(), "image missing").when(F.col("sha256").isNotNull() & (F.lower("sha256") != F.col("__actual")), "sha256 mismatch")
    judged = both.withColumn("problem", problem)
    return judged.where("problem is null").select(good.columns), bad.unionByName(judged.where("problem is not null").select("line_number", "id", "problem"))


def layout_training_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entries with safe paths, a page of positive size and counts of blocks that aren't negative."""
    rules = [
        ("no id", _empty("id")), ("no document_id", _empty("document_id")), ("no split", _empty("split")), ("no subset", _empty("subset")),
        ("unsafe image", _unsafe("image")), ("unsafe layout_ground_truth", _unsafe("layout_ground_truth")),
        ("page without size", ~((F.col("e.width") >= 1) & (F.col("e.height") >= 1))),
        ("negative count", F.exists(F.coalesce(F.map_values("e.block_counts"), F.array().cast("array<int>")), lambda n: n < 0)),
    ]
    return _checked(_entries(spark, path, LAYOUT_TRAINING), rules)


def layout_target_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entries of the splits train, dev and test with safe paths of image and mask."""
    rules = [("no id", _empty("id")), ("bad split", ~F.coalesce(F.col("e.split").isin("train", "dev", "test"), F.lit(False))), ("unsafe image", _unsafe("image")), ("unsafe mask", _unsafe("mask"))]
    return _checked(_entries(spark, path, LAYOUT_TARGETS), rules)


# --- documents and reports ---------------------------------------------------------------------------------------------------

BOX = "struct<x:int,y:int,width:int,height:int>"
CELL = "struct<row:int,column:int,text:string,row_span:int,column_span:int>"
BLOCK = f"struct<type:string,text:string,bbox:{BOX},confidence:double,level:int,cells:array<{CELL}>,metadata:map<string,string>>"
DOCUMENT = f"schema_version string, pages array<struct<number:int,width:int,height:int,blocks:array<{BLOCK}>>>, metadata map<string,string>"


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Document trees, one for each file: file, the document, and its problem if it doesn't parse. Cells span one row and column unless they say otherwise."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    rows = raw.withColumn("d", F.from_json("value", DOCUMENT + ", __bad string", {"columnNameOfCorruptRecord": "__bad"}))
    problem = F.when(F.col("d").isNull() | F.col("d.__bad").isNotNull(), "bad document").when(F.col("d.pages").isNull(), "no pages")
    return rows.select("file", F.struct("d.schema_version", "d.pages", "d.metadata").alias("document"), problem.alias("problem"))


def document_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of documents in order: file, page (from 1, by place), page_width, page_height, ord (from 0), type, text, confidence, level, box, cells, metadata."""
    pages = docs.where("problem is null").select("file", F.posexplode("document.pages").alias("p", "page"))
    each = pages.select("file", (F.col("p") + 1).alias("page"), F.col("page.width").alias("page_width"), F.col("page.height").alias("page_height"), F.posexplode("page.blocks").alias("ord", "b"))
    span = lambda c, k: F.coalesce(c[k], F.lit(1)).alias(k)
    cells = F.transform("b.cells", lambda c: F.struct(c["row"].alias("row"), c["column"].alias("column"), c["text"].alias("text"), span(c, "row_span"), span(c, "column_span")))
    return each.select("file", "page", "page_width", "page_height", "ord", "b.type", "b.text", "b.confidence", "b.level", F.col("b.bbox.x").alias("x"), F.col("b.bbox.y").alias("y"), F.col("b.bbox.width").alias("w"), F.col("b.bbox.height").alias("h"), F.coalesce(cells, F.array().cast(f"array<{CELL}>")).alias("cells"), "b.metadata")


def ground_truth_problems(docs: DataFrame) -> DataFrame:
    """(file, block, cell, problem) of layout ground truth: one page of positive size, blocks with boxes inside of it, tables with positive shapes
    whose cells lie in them, span something and don't overlap. A document that doesn't parse has that one problem."""
    none = F.lit(None).cast("int")
    parsed = docs.where("problem is null")
    single = F.size("document.pages") == 1
    head = docs.where("problem is not null").select("file", none.alias("block"), none.alias("cell"), "problem")
    many = parsed.where(~single).select("file", none.alias("block"), none.alias("cell"), F.lit("not one page").alias("problem"))
    flat = parsed.where(single).select("file", F.col("document.pages")[0].alias("page"))
    size = flat.where(~F.coalesce((F.col("page.width") >= 1) & (F.col("page.height") >= 1), F.lit(False))).select("file", none.alias("block"), none.alias("cell"), F.lit("page without size").alias("problem"))
    blocks = document_blocks(parsed.where(single))
    positive = lambda name: F.coalesce(F.col("metadata").getItem(name).try_cast("int") >= 1, F.lit(False))
    boxed = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("w").isNotNull() & F.col("h").isNotNull()
    table = boxed & (F.col("type") == "table")
    rules = [
        ("no box", ~boxed),
        ("negative place", boxed & ((F.col("x") < 0) | (F.col("y") < 0))),
        ("box without size", boxed & ((F.col("w") < 1) | (F.col("h") < 1))),
        ("box outside the page", boxed & ((F.col("x") + F.col("w") > F.col("page_width")) | (F.col("y") + F.col("h") > F.col("page_height")))),
        ("no number of rows", table & ~positive("rows")),
        ("no number of columns", table & ~positive("columns")),
    ]
    named = lambda rs: F.explode(F.array_compact(F.array(*(F.when(bad, F.lit(n)) for n, bad in rs)))).alias("problem")
    of_blocks = blocks.select("file", F.col("ord").alias("block"), none.alias("cell"), named(rules))
    cells = blocks.where(table).select("file", F.col("ord").alias("block"), *(F.when(positive(k), F.col("metadata").getItem(k).try_cast("int")).alias(k) for k in ("rows", "columns")), F.posexplode("cells").alias("cell", "c"))
    placed, spans = (F.col("c.row") >= 0) & (F.col("c.column") >= 0), (F.col("c.row_span") >= 1) & (F.col("c.column_span") >= 1)
    cell_rules = [
        ("negative cell", ~placed),
        ("cell without span", placed & ~spans),
        ("cell beyond the rows", placed & spans & F.coalesce(F.col("c.row") + F.col("c.row_span") > F.col("rows"), F.lit(False))),
        ("cell beyond the columns", placed & spans & F.coalesce(F.col("c.column") + F.col("c.column_span") > F.col("columns"), F.lit(False))),
    ]
    of_cells = cells.select("file", "block", "cell", named(cell_rules))
    run = lambda a, n: F.sequence(F.col(f"c.{a}"), F.col(f"c.{a}") + F.col(f"c.{n}") - 1)
    grid = cells.where(placed & spans).select("file", "block", "cell", F.explode(run("row", "row_span")).alias("r"), F.col("c")).select("file", "block", "cell", "r", F.explode(run("column", "column_span")).alias("k"))
    first = F.min("cell").over(Window.partitionBy("file", "block", "r", "k"))
    overlaps = grid.withColumn("first", first).where("cell > first").select("file", "block", "cell").distinct().withColumn("problem", F.lit("cell overlaps another"))
    return head.unionByName(many).unionByName(size).unionByName(of_blocks).unionByName(of_cells).unionByName(overlaps)


REPORT = "schema_version string, overall map<string,double>, subsets map<string,map<string,double>>, tags map<string,map<string,double>>, samples array<struct<id:string,subset:string,tags:array<string>,cer:double,uncalibrated_confidence:double>>, freeze struct<lock_sha256:string,frozen_manifest_sha256:string,lock_file:string,frozen_manifest:string,sample_count:int>"


def benchmark_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(slices, samples, violations) of reports: slices are kind, name and metrics; a report needs schema 1, overall metrics and samples with unique ids and subsets."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", REPORT + ", __bad string", {"columnNameOfCorruptRecord": "__bad"}).alias("r"))
    whole = F.col("r").isNotNull() & F.col("r.__bad").isNull()
    rules = [("bad report", ~whole), ("unknown schema", whole & ~F.col("r.schema_version").eqNullSafe(F.lit("1"))), ("no overall metrics", whole & F.col("r.overall").isNull()), ("no samples", whole & F.col("r.samples").isNull())]
    head = raw.select("file", F.explode(F.array_compact(F.array(*(F.when(bad, F.lit(n)) for n, bad in rules)))).alias("problem"))
    slice_ = lambda kind, name, m: F.struct(F.lit(kind).alias("kind"), name.alias("name"), m.alias("metrics"))
    nested = lambda kind, c: F.transform(F.coalesce(F.map_entries(c), F.array().cast("array<struct<key:string,value:map<string,double>>>")), lambda e: slice_(kind, e["key"], e["value"]))
    every = F.concat(F.array(slice_("overall", F.lit("all"), F.col("r.overall"))), nested("subset", "r.subsets"), nested("tag", "r.tags"))
    slices = raw.where("r.overall is not null").select("file", F.explode(every).alias("s")).select("file", "s.*")
    samples = raw.where("r.samples is not null").select("file", F.explode("r.samples").alias("s")).select("file", "s.*")
    times = F.count("*").over(Window.partitionBy("file", "id"))
    odd = samples.withColumn("n", times).select("file", F.explode(F.array_compact(F.array(F.when(F.coalesce(F.col("id"), F.lit("")) == "", "sample without id"), F.when(F.col("n") > 1, "sample twice"), F.when(F.col("subset").isNull(), "sample without subset")))).alias("problem"))
    return slices, samples, head.unionByName(odd.distinct())


# --- registries, suites, packs, worksheets -------------------------------------------------------------------------------------

REGISTRY = "sources array<struct<id:string,status:string,evidence:struct<text_layer:string,pages:int>>>"
SUITE = "schema_version string, id string, sources array<struct<id:string,pages:array<double>,expected_text_layer:string,rotation_probe:boolean,max_source_mb:double,note:string>>"
PACK = "schema_version string, pack_id string, pages array<struct<id:string,image:string,ground_truth:string,sha256:string,lines:array<string>,template:string,tags:array<string>>>"
CAPTURE_SUITE = "schema_version string, suite_id string, packs array<struct<template:string,pack_id:string,manifest:string,printable_pdf:string,page_count:int>>"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", schema).alias("j"))


def registry(spark: SparkSession, path: str) -> DataFrame:
    """Sources of a registry: ord, id, status, text_layer, pages; entries without an id don't count, the last of equal ids does."""
    each = _json(spark, path, REGISTRY).select(F.posexplode("j.sources").alias("ord", "s")).where(F.coalesce(F.col("s.id"), F.lit("")) != "")
    last = F.max("ord").over(Window.partitionBy("s.id"))
    return each.withColumn("last", last).where("ord = last").select("ord", "s.id", "s.status", "s.evidence.text_layer", "s.evidence.pages")


def diagnostic_suite(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entries (ord, id, pages without repeats in their order, expected_text_layer, rotation_probe, max_source_mb, note) and (id, problem)."""
    whole = _json(spark, path, SUITE)
    none = F.lit(None).cast("string")
    head_rules = [("unknown schema", ~F.col("j.schema_version").eqNullSafe(F.lit("1"))), ("no suite id", F.trim(F.coalesce(F.col("j.id"), F.lit(""))) == ""), ("no sources", F.coalesce(F.size("j.sources"), F.lit(0)) < 1)]
    head = whole.select(none.alias("id"), F.explode(F.array_compact(F.array(*(F.when(b, F.lit(n)) for n, b in head_rules)))).alias("problem"))
    each = whole.select(F.posexplode("j.sources").alias("ord", "s")).select("ord", "s.*").withColumns({"id": F.trim(F.coalesce("id", F.lit(""))), "expected_text_layer": F.trim(F.coalesce("expected_text_layer", F.lit(""))), "n": F.count("*").over(Window.partitionBy("id"))})
    rules = [
        ("no id", F.col("id") == ""), ("duplicate id", F.col("n") > 1), ("no pages", F.coalesce(F.size("pages"), F.lit(0)) < 1),
        ("bad page", F.exists(F.coalesce("pages", F.array().cast("array<double>")), lambda p: p.isNull() | (p < 1) | (p != F.floor(p)))),
        ("no expected text layer", F.col("expected_text_layer") == ""), ("bad size", F.coalesce(F.col("max_source_mb") <= 0, F.lit(False))),
    ]
    judged = each.withColumn("problems", F.array_compact(F.array(*(F.when(b, F.lit(n)) for n, b in rules))))
    pages = F.array_distinct(F.transform("pages", lambda p: p.cast("int")))
    good = judged.where(F.size("problems") == 0).select("ord", "id", pages.alias("pages"), "expected_text_layer", F.coalesce("rotation_probe", F.lit(False)).alias("rotation_probe"), "max_source_mb", "note")
    return good, head.unionByName(judged.select("id", F.explode("problems").alias("problem")))


def capture_suite(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Packs of a capture suite (suite_id, template, pack_id, manifest, printable_pdf, page_count) and (file, problem)."""
    whole = _json(spark, path, CAPTURE_SUITE)
    rules = [("unknown schema", ~F.col("j.schema_version").eqNullSafe(F.lit("1"))), ("no packs", F.coalesce(F.size("j.packs"), F.lit(0)) < 1)]
    return whole.select("j.suite_id", F.explode("j.packs").alias("p")).select("suite_id", "p.*"), whole.select("file", F.explode(F.array_compact(F.array(*(F.when(b, F.lit(n)) for n, b in rules)))).alias("problem"))


def capture_pack(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Pages of capture packs (pack_id, page, image, ground_truth, sha256, lines, template, tags) and (file, problem)."""
    whole = _json(spark, path, PACK)
    rules = [("unknown schema", ~F.col("j.schema_version").eqNullSafe(F.lit("1"))), ("no pages", F.coalesce(F.size("j.pages"), F.lit(0)) < 1)]
    pages = whole.select("file", "j.pack_id", F.explode("j.pages").alias("p")).select("file", "pack_id", F.col("p.id").alias("page"), "p.image", "p.ground_truth", "p.sha256", "p.lines", F.coalesce("p.template", F.lit("plain")).alias("template"), F.coalesce("p.tags", F.array().cast("array<string>")).alias("tags"))
    unsafe = pages.where(~tx.safe_relative(F.col("image")) | ~tx.safe_relative(F.col("ground_truth"))).select("file", F.lit("unsafe path").alias("problem"))
    return pages, whole.select("file", F.explode(F.array_compact(F.array(*(F.when(b, F.lit(n)) for n, b in rules)))).alias("problem")).unionByName(unsafe)


def worksheet(spark: SparkSession, path: str, modes: list[str]) -> tuple[DataFrame, DataFrame]:
    """Pages of a capture worksheet (combined_page, template, page_id, modes sorted) and (page_id, problem)."""
    columns = ("combined_page", "template", "page_id", "required_capture_modes")
    raw = spark.read.csv(path, header=True, inferSchema=False)
    lacking = [c for c in columns if c not in raw.columns]
    if lacking:
        none = spark.createDataFrame([], "combined_page int, template string, page_id string, modes array<string>")
        return none, spark.createDataFrame([(None, f"no column {c}") for c in lacking], "page_id string, problem string")
    wanted = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.coalesce("required_capture_modes", F.lit("")), ";"), lambda m: F.trim(m)), lambda m: m != "")))
    rows = raw.select(F.trim("combined_page").try_cast("int").alias("combined_page"), F.trim(F.coalesce("template", F.lit(""))).alias("template"), F.trim(F.coalesce("page_id", F.lit(""))).alias("page_id"), wanted.alias("modes"))
    times = lambda c: F.count("*").over(Window.partitionBy(c))
    rules = [
        ("bad page number", ~F.coalesce(F.col("combined_page") >= 1, F.lit(False))), ("page number twice", F.col("combined_page").isNotNull() & (times("combined_page") > 1)),
        ("unsafe page id", ~F.col("page_id").rlike(SAFE_ID)), ("page id twice", times("page_id") > 1), ("no template", F.col("template") == ""),
        ("no modes", F.size("modes") == 0), ("unknown mode", F.size(F.array_except("modes", F.array(*map(F.lit, modes)))) > 0),
    ]
    judged = rows.withColumn("problems", F.array_compact(F.array(*(F.when(b, F.lit(n)) for n, b in rules))))
    none = rows.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(None).cast("string").alias("page_id"), F.lit("no pages").alias("problem"))
    return judged.where(F.size("problems") == 0).drop("problems"), judged.select("page_id", F.explode("problems").alias("problem")).unionByName(none)


# --- listings --------------------------------------------------------------------------------------------------------------------

#: What entries of a storage folder can be.
CATEGORIES = (
    "directory",
    "legacy_temporary_candidate",
    "recoverable_stage_candidate",
    "coordination_lock_candidate",
    "other_regular_file",
    "hardlinked_file",
    "symlink",
    "special_file",
    "unreadable_entry",
)
#: The folder where writes are staged.
STAGING = ".staging"


def category(kind: Column, path: Column, links: Column, staging: str = STAGING) -> Column:
    """What an entry is: by kind (file, directory, symlink, other or null), number of links and the shape of its path."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    staged = (F.size(parts) == 2) & (F.get(parts, F.lit(0)) == staging)
    return (
        F.when(kind.isNull(), "unreadable_entry")
        .when(kind == "directory", "directory")
        .when(kind == "symlink", "symlink")
        .when(kind != "file", "special_file")
        .when(links != 1, "hardlinked_file")
        .when(staged & name.rlike(r"^[0-9a-f]{64}\.part\z"), "recoverable_stage_candidate")
        .when(staged & name.rlike(r"^lock-[0-3][0-9a-f]\z"), "coordination_lock_candidate")
        .when(name.rlike(r"(?s)^\..+\.[0-9a-f]{32}\.tmp\z"), "legacy_temporary_candidate")
        .otherwise("other_regular_file")
    )


def inventory(entries: DataFrame, most_entries: int = 10_000, most_items: int = 200, staging: str = STAGING) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(categories, items, status) of a listing (ord, path, kind, size, links).

    The first ``most_entries`` in order of ``ord`` count; at that number a listing can't claim to be whole. All nine categories are
    given with count and bytes. Items are the first ``most_items``, named by the hash of their path and sorted by it; status is one row.
    """
    seen = entries.orderBy("ord").limit(most_entries).withColumn("category", category(F.col("kind"), F.col("path"), F.col("links"), staging))
    bytes_ = F.greatest(F.lit(0), F.when(F.col("kind") == "file", F.coalesce("size", F.lit(0))).otherwise(0)).cast("long")
    names = entries.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    counts = seen.groupBy("category").agg(F.count("*").alias("n"), F.sum(bytes_).alias("bytes"))
    categories = names.join(counts, "category", "left").na.fill(0)
    items = seen.orderBy("ord").limit(most_items).select(F.sha2("path", 256).alias("path_id"), "category", F.when(F.col("kind") == "file", F.col("size")).alias("size"), "links").orderBy("path_id")
    status = seen.agg(F.count("*").alias("entries_seen")).select("entries_seen", (F.col("entries_seen") >= most_entries).alias("entry_limit"), F.greatest(F.lit(0), F.col("entries_seen") - most_items).alias("items_omitted"))
    return categories, items, status.withColumn("status", F.when(F.col("entry_limit"), "partial").otherwise("complete"))


def multipart_listing(pages: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """(uploads, status) of a paginated listing: page_no, key_marker and upload_marker to go on with (null on the last page), uploads (key, upload_id).

    Pages count up to the first that breaks a rule: a key or marker outside of ``prefix``, an upload seen before, a marker seen before, or a
    marker that moves backwards; that page gives nothing and is named in the status. Markers are compared as bytes.
    """
    w = Window.orderBy("page_no")  # one row for each page of a listing, not for each upload
    marks = pages.select("page_no", "key_marker", "upload_marker")
    marks = marks.withColumn("before", F.lag(F.encode("key_marker", "UTF-8")).over(w)).withColumn("times", F.row_number().over(Window.partitionBy("key_marker", "upload_marker").orderBy("page_no")))
    each = pages.select("page_no", F.explode("uploads").alias("u")).select("page_no", "u.key", "u.upload_id")
    first = each.withColumn("k", F.row_number().over(Window.partitionBy("key", "upload_id").orderBy("page_no")))
    per = first.groupBy("page_no").agg(F.max((F.col("k") > 1).cast("int")).alias("again"), F.max((~F.col("key").startswith(prefix)).cast("int")).alias("foreign"), F.count("*").alias("n"))
    told = marks.join(per, "page_no", "left")
    more = F.col("key_marker").isNotNull()
    problem = (
        F.when((more & ~F.col("key_marker").startswith(prefix)) | (F.col("foreign") == 1), "invalid_response")
        .when(more & (F.col("times") > 1), "pagination_cycle")
        .when(F.col("again") == 1, "duplicate_upload")
        .when(more & F.col("before").isNotNull() & (F.encode("key_marker", "UTF-8") < F.col("before")), "pagination_regression")
    )
    told = told.withColumn("problem", problem)
    # the first page that breaks a rule, or the last one where the listing ended
    stop = told.agg(F.min(F.when(F.col("problem").isNotNull(), F.col("page_no"))).alias("bad"), F.min(F.when(~more, F.col("page_no"))).alias("end"), F.min_by("problem", F.when(F.col("problem").isNotNull(), F.col("page_no"))).alias("why"))
    stop = stop.withColumn("ended", F.coalesce(F.col("end") < F.coalesce("bad", F.lit(1 << 60)), F.lit(False)))
    accepted = told.join(F.broadcast(stop), F.lit(True)).where(F.when(F.col("ended"), F.col("page_no") <= F.col("end")).otherwise(F.col("bad").isNull() | (F.col("page_no") < F.col("bad"))))  # one row
    uploads = each.join(accepted.select("page_no"), "page_no", "left_semi")
    totals = accepted.agg(F.count("*").alias("pages_accepted"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("uploads_observed"))
    status = totals.join(F.broadcast(stop), F.lit(True)).select("pages_accepted", "uploads_observed", F.when(F.col("ended"), "complete").otherwise("partial").alias("status"), F.when(~F.col("ended"), F.col("why")).alias("issue"))
    return uploads, status


def journal_rows(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(entries in order of job_id, violations) of a journal table (job_id, artifact_key, workspace_pending, retry_at, failures) of at most ``most`` rows."""
    rules = [("no job id", F.coalesce(F.col("job_id"), F.lit("")) == ""), ("bad flag", ~F.coalesce(F.col("workspace_pending").isin(0, 1), F.lit(False))), ("bad time", F.try_to_timestamp("retry_at").isNull()), ("bad failures", ~F.coalesce(F.col("failures") >= 0, F.lit(False)))]
    read = rows.orderBy("job_id").limit(most + 1)
    times = F.count("*").over(Window.partitionBy("job_id"))
    judged = read.withColumn("n", times).withColumn("problems", F.array_compact(F.array(*(F.when(b, F.lit(n)) for n, b in rules), F.when(F.col("n") > 1, "duplicate job"))))
    full = read.agg(F.count("*").alias("n")).where(F.col("n") > most).select(F.lit(None).cast("string").alias("job_id"), F.lit("too many entries").alias("problem"))
    good = judged.where(F.size("problems") == 0).select("job_id", "artifact_key", (F.col("workspace_pending") == 1).alias("workspace_pending"), F.to_timestamp("retry_at").alias("retry_at"), "failures").orderBy("job_id")
    return good, judged.select("job_id", F.explode("problems").alias("problem")).unionByName(full)
