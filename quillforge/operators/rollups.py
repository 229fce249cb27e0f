"""Evaluation roll-ups: suites, freezes, layout entries, documents, orientation reviews, telemetry, bundles, queues, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillforge.functions import text as tx
from quillforge.functions.geometry import TYPES
from quillforge.operators.datasets import is_real_source


def counted(rows: DataFrame, axes: dict[str, Column]) -> DataFrame:
    """(axis, value, n): how often each value of each axis occurs; null is left out. One scan, one shuffle of distinct pairs."""
    pairs = F.array(*(F.struct(F.lit(k).alias("axis"), v.cast("string").alias("value")) for k, v in axes.items()))
    each = rows.select(F.explode(pairs).alias("p")).where("p.value is not null")
    return each.groupBy("p.axis", "p.value").agg(F.count("*").alias("n"))


# --- suites of sources -------------------------------------------------------------------------------------------------


def suite_counts(sources: DataFrame, pages: DataFrame) -> DataFrame:
    """(axis, value, n) of a suite run.

    ``sources``: source, status, text_layer. ``pages``: source, and where they were taken layer_gap, band, media, probed (whether a
    probe ran), recommended (degrees or null), turned (degrees or null), skipped and skip_reason, strategy.
    """
    unknown = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    of_source = counted(sources, {"source_statuses": unknown("status"), "registry_text_layers": F.when(F.coalesce(F.col("text_layer"), F.lit("")) == "", "unknown").otherwise(F.col("text_layer"))})
    state = F.when(F.col("skipped"), F.coalesce("skip_reason", F.lit("skipped"))).otherwise("probed")
    of_page = counted(
        pages,
        {
            "layer_gap_classifications": F.col("layer_gap"),
            "ocr_confidence_bands": F.col("band"),
            "page_media_classifications": F.col("media"),
            "rotation_recommendations": F.when(F.col("probed"), F.coalesce(F.col("recommended").cast("string"), F.lit("none"))),
            "applied_auto_orientations": F.col("turned"),
            "auto_orientation_probe_states": F.when(F.col("skipped").isNotNull(), state),
            "auto_orientation_strategies": F.when(F.col("skipped").isNotNull(), unknown("strategy")),
        },
    )
    return of_source.unionByName(of_page)


def suite_totals(sources: DataFrame, pages: DataFrame) -> DataFrame:
    """One row: sources, ok and errors, sampled pages, characters of both layers, seconds, and number, least, mean and greatest of both margins."""
    of_source = sources.agg(F.count("*").alias("sources"), F.count_if(F.col("status") == "ok").alias("ok")).withColumn("errors", F.col("sources") - F.col("ok"))
    total = lambda c, name, kind: F.coalesce(F.sum(c), F.lit(0)).cast(kind).alias(name)
    margins = [m for name in ("probe_margin", "orientation_margin") for m in (F.count(name).alias(f"{name}_samples"), F.min(name).alias(f"{name}_min"), F.avg(name).alias(f"{name}_mean"), F.max(name).alias(f"{name}_max"))]
    of_page = pages.agg(F.count("*").alias("sampled_pages"), total("native_chars", "native_chars", "long"), total("ocr_chars", "ocr_chars", "long"), total("seconds", "seconds", "double"), *margins)
    both = of_source.join(F.broadcast(of_page), F.lit(True))  # two single rows
    return both.withColumn("ocr_minus_native", F.col("ocr_chars") - F.col("native_chars"))


# --- freezes and layout entries ----------------------------------------------------------------------------------------


def freeze_summary(samples: DataFrame, split: str) -> DataFrame:
    """One row for a frozen split: samples, documents, sorted document ids, and sorted (name, n) of subsets and tags.

    The list of documents is what a lock holds; a benchmark split is small by nature. See ``freeze_counts`` for the long form.
    """
    chosen = samples.where(F.col("split") == split)
    pairs = lambda axis: F.array_sort(F.collect_list(F.when(F.col("axis") == axis, F.struct(F.col("value").alias("name"), F.col("n")))))
    counts = freeze_counts(samples, split).groupBy().agg(pairs("subset").alias("subsets"), pairs("tag").alias("tags"))
    ids = chosen.select("document_id").distinct().agg(F.array_sort(F.collect_list("document_id")).alias("document_ids"))
    size = chosen.agg(F.count("*").alias("sample_count"))
    one = size.join(F.broadcast(ids), F.lit(True)).join(F.broadcast(counts), F.lit(True))  # three single rows
    return one.withColumn("document_count", F.size("document_ids").cast("long"))


def freeze_counts(samples: DataFrame, split: str) -> DataFrame:
    """(axis, value, n) of a split's subsets and tags."""
    chosen = samples.where(F.col("split") == split)
    every = F.concat(F.array(F.struct(F.lit("subset").alias("axis"), F.col("subset").alias("value"))), F.transform("tags", lambda t: F.struct(F.lit("tag").alias("axis"), t.alias("value"))))
    return chosen.select(F.explode(every).alias("p")).groupBy("p.axis", "p.value").agg(F.count("*").alias("n"))


def freeze_blockers(samples: DataFrame, split: str, real: bool = False, reviewed: bool = False) -> DataFrame:
    """(id, problem) of samples that keep a split from being frozen: not from a real source, not approved."""
    problems = F.array_compact(F.array(F.when(F.lit(real) & ~is_real_source(F.col("tags")), "no real source"), F.when(F.lit(reviewed) & (F.coalesce(F.col("status"), F.lit("")) != "approved"), "not approved")))
    return samples.where(F.col("split") == split).select("id", F.explode(problems).alias("problem"))


def layout_entries(samples: DataFrame, pages: DataFrame, blocks: DataFrame, splits: list[str] | None = None) -> DataFrame:
    """Training entries of samples with layout ground truth: the sample's columns, its page's width and height, and its blocks by type as a sorted map.

    ``samples``: id, split, layout_ground_truth (or null), ...; ``pages``: id, width, height; ``blocks``: id, type.
    """
    chosen = samples.where(F.col("layout_ground_truth").isNotNull())
    chosen = chosen if splits is None else chosen.where(F.col("split").isin(splits))
    per = blocks.groupBy("id", "type").agg(F.count("*").alias("n")).groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("block_counts"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    return chosen.join(pages.select("id", "width", "height"), "id").join(per, "id", "left").withColumn("block_counts", F.coalesce("block_counts", empty))


def layout_summary(entries: DataFrame) -> DataFrame:
    """(axis, value, n) over entries: by split, subset and tag, and the blocks of all entries by type."""
    part = lambda axis, value, n: F.struct(F.lit(axis).alias("axis"), value.alias("value"), n.cast("long").alias("n"))
    one = F.lit(1)
    every = F.concat(F.array(part("split", F.col("split"), one), part("subset", F.col("subset"), one)), F.transform("tags", lambda t: part("tag", t, one)), F.transform(F.map_entries("block_counts"), lambda e: part("block_type", e["key"], e["value"])))
    return entries.select(F.explode(every).alias("p")).groupBy("p.axis", "p.value").agg(F.sum("p.n").alias("n"))


def box_targets(blocks: DataFrame, classes: dict[str, int]) -> DataFrame:
    """Training targets of blocks (page, ord, type, box): class id, name and box, numbered from 0 in order of ``ord``; blocks without a box are violations (class null)."""
    ids = F.create_map(*(x for k, v in classes.items() for x in (F.lit(k), F.lit(v))))
    order = F.row_number().over(_by_page()) - 1
    has_box = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("w").isNotNull() & F.col("h").isNotNull()
    return blocks.select("page", order.alias("order"), F.when(has_box, F.try_element_at(ids, F.col("type"))).alias("class_id"), F.col("type").alias("class_name"), "x", "y", "w", "h")


def _by_page():
    from pyspark.sql import Window

    return Window.partitionBy("page").orderBy("ord")


# --- documents ---------------------------------------------------------------------------------------------------------


def document_stats(blocks: DataFrame) -> DataFrame:
    """Per document: blocks of each type (none counts 0), confidences and their mean (null without any)."""
    kinds = [F.count_if(F.col("type") == t).alias(t) for t in TYPES]
    return blocks.groupBy("document").agg(*kinds, F.count("confidence").alias("confidence_samples"), F.avg("confidence").alias("mean_block_confidence"))


def probe_metrics(has_lines: Column, line_confidence: Column, line_chars: Column, line_score: Column, block_confidence: Column, letters: Column) -> Column:
    """(confidence, characters, score) of a page: those of its lines, else from blocks: confidence * ln(1 + letters)."""
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    chars = F.greatest(F.lit(0), F.coalesce(F.when(has_lines, line_chars).otherwise(letters), F.lit(0))).cast("long")
    confidence = F.when(has_lines, zero(line_confidence)).otherwise(zero(block_confidence))
    return F.struct(confidence.alias("confidence"), chars.alias("characters"), F.when(has_lines, zero(line_score)).otherwise(confidence * F.log1p(chars)).alias("score"))


#: Shares of a page that count as a whole and as a part, and the characters of a sparse text layer.
WHOLE, PART, SPARSE = 0.90, 0.20, 32


def media_class(coverage: Column, native_solid: Column) -> Column:
    """What a page is made of, from its largest image's share and the solid characters of its own text."""
    raster = F.when(native_solid == 0, "full-page-raster-no-text-layer").when(native_solid <= SPARSE, "full-page-raster-sparse-text-layer").otherwise("full-page-raster-with-text-overlay")
    share = F.coalesce(coverage, F.lit(0.0))
    return F.when(share >= WHOLE, raster).when(share >= PART, "partial-raster-content").otherwise("no-large-raster-layer")


def layer_gap(native: dict[str, Column], ocr: dict[str, Column]) -> Column:
    """How a page's own text differs from the recognized one, by the first rule that holds; both as ``text.layer_counts`` gives them."""
    letters = native["lao"] + native["latin"] + native["other"]
    strange = (native["solid"] >= 100) & (native["other"] >= F.greatest(F.lit(20), F.floor(letters * 0.15))) & (ocr["other"] <= F.greatest(F.lit(5), F.floor(native["other"] * 0.1))) & (ocr["lao"] + ocr["latin"] >= 50)
    return (
        F.when((native["solid"] == 0) & (ocr["solid"] > 0), "native-layer-empty")
        .when((native["solid"] <= SPARSE) & (ocr["solid"] >= F.greatest(F.lit(100), native["solid"] * 5)), "native-layer-sparse")
        .when(strange, "native-layer-script-anomaly")
        .when((ocr["lao"] >= 50) & (native["lao"] < F.greatest(F.lit(5), F.floor(ocr["lao"] * 0.1))), "lao-missing-from-native-layer")
        .when((native["solid"] > 0) & (ocr["solid"] >= native["solid"] * 2), "ocr-much-richer-than-native")
        .otherwise("no-large-gap-detected")
    )


#: Confidences from which a page reads medium and high.
MEDIUM, HIGH = 0.60, 0.80


def confidence_band(mean: Column) -> Column:
    return F.when(mean.isNull(), "no-confidence").when(mean < MEDIUM, "low").when(mean < HIGH, "medium").otherwise("high")


def image_coverage(images: DataFrame) -> DataFrame:
    """Per page: images and the largest share of the page that one covers, within 0 and 1. ``images``: page, image, w, h, page_width, page_height."""
    area = F.col("page_width") * F.col("page_height")
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("w") * F.col("h") / F.when(area == 0, 1.0).otherwise(area)))
    return images.groupBy("page").agg(F.countDistinct("image").alias("image_count"), F.max(share).alias("max_coverage"))


def fidelity(reference: DataFrame, prediction: DataFrame, pages: DataFrame) -> DataFrame:
    """Per document: pages on both sides, the means over compared pages, and their composite times the page-count score.

    ``reference`` and ``prediction``: document, page. ``pages``: document, page and the measures of each compared page.
    """
    n = lambda rows, name: rows.groupBy("document").agg(F.count("*").alias(name))
    means = pages.groupBy("document").agg(F.count("*").alias("compared_pages"), *(F.avg(c).alias(c) for c in ("pixel_similarity", "foreground_iou", "edge_f1")), F.avg("composite_score").alias("mean_composite"))
    both = n(reference, "reference_pages").join(n(prediction, "predicted_pages"), "document").join(means, "document")
    both = both.withColumn("page_count_score", F.least("reference_pages", "predicted_pages") / F.greatest("reference_pages", "predicted_pages"))
    return both.withColumn("composite_score", F.col("mean_composite") * F.col("page_count_score")).drop("mean_composite")


# --- orientation -------------------------------------------------------------------------------------------------------


def orientation_review(documents: DataFrame, records: DataFrame) -> DataFrame:
    """Per document: status, pages to review and pages not assessed, both sorted.

    ``documents``: document, page_count, requested (true, false or null). ``records``: document, page, degrees and the candidates of that
    page: array of (degrees, geometry). A page is assessed by exactly one record whose turn has exactly one candidate with sound geometry.
    """
    sound = F.filter("candidates", lambda c: c["degrees"] == F.col("degrees"))
    geometry = F.when(F.col("degrees").isin(0, 90, 180, 270) & (F.size(sound) == 1), F.get(sound, F.lit(0))["geometry"])
    g = F.col("g")
    axis = lambda a: (g[f"{a}_characters"] >= 2 * g[f"{a}_lines"]) & ((g[f"{a}_lines"] > 0) | (g[f"{a}_characters"] == 0))
    fine = sanitized(g) & (g["horizontal_lines"] + g["vertical_lines"] > 0) & axis("horizontal") & axis("vertical")
    per_page = records.withColumn("g", geometry).groupBy("document", "page").agg(F.count("*").alias("n"), F.max(F.when(F.coalesce(fine, F.lit(False)), sideways(g))).alias("sideways"))
    every = documents.select("document", "page_count", "requested", F.explode_outer(F.when(F.col("page_count") > 0, F.sequence(F.lit(1), F.col("page_count").cast("int")))).alias("page"))
    state = F.when((F.col("n") == 1) & F.col("requested"), F.col("sideways"))
    joined = every.join(per_page, ["document", "page"], "left").withColumn("state", state)
    pages = lambda cond: F.array_sort(F.collect_list(F.when(cond & F.col("page").isNotNull(), F.col("page"))))
    got = joined.groupBy("document", "page_count", "requested").agg(pages(F.coalesce(F.col("state"), F.lit(False))).alias("review_pages"), pages(F.col("state").isNull()).alias("unassessed_pages"))
    status = (
        F.when(~F.col("requested"), "not-requested")
        .when(F.col("requested").isNull(), "not-assessed")
        .when(F.size("review_pages") > 0, "review-required")
        .when((F.size("unassessed_pages") > 0) | (F.col("page_count") == 0), "incomplete")
        .otherwise("no-sideways-evidence")
    )
    return got.withColumn("status", status)


def sideways(g: Column) -> Column:
    """Whether line geometry speaks for sideways text: two vertical lines or more, with more characters than the horizontal ones."""
    return (g["vertical_lines"] >= 2) & (g["vertical_characters"] > g["horizontal_characters"])


#: Fixed value: the version that geometry must state.
GEOMETRY_VERSION = "multi-character-line-axis-v1"
GEOMETRY_COUNTS = ("horizontal_lines", "vertical_lines", "horizontal_characters", "vertical_characters", "ignored_lines")


def sanitized(g: Column) -> Column:
    """Whether geometry is of the known version and all its counts are there and not negative."""
    ok = g["version"] == GEOMETRY_VERSION
    for c in GEOMETRY_COUNTS:
        ok = ok & (g[c] >= 0)
    return F.coalesce(ok, F.lit(False))


# --- recognition telemetry, pair models, calibration points --------------------------------------------------------------


def telemetry(rows: DataFrame) -> DataFrame:
    """One row of development figures: CER over normalized texts, empty and blank ratios (null of nothing).

    ``rows``: reference, hypothesis, steps and blank_steps of each decoded line.
    """
    r, h = tx.normalize_text(F.col("reference")), tx.normalize_text(F.col("hypothesis"))
    each = rows.select(r.alias("r"), h.alias("h"), "reference", "hypothesis", "steps", "blank_steps").withColumn("edits", tx.char_edits(F.col("r"), F.col("h")))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    sums = each.agg(
        F.count("*").alias("samples"), total(F.col("edits")).alias("character_edits"), total(F.char_length("r")).alias("characters"), F.count_if(F.col("hypothesis") == "").alias("empty_predictions"),
        total(F.char_length("hypothesis")).alias("predicted_characters"), total(F.char_length("reference")).alias("reference_characters"), total(F.col("blank_steps")).alias("blank_timesteps"), total(F.col("steps")).alias("valid_timesteps"),
    )
    ratio = lambda a, b: F.try_divide(F.col(a), F.col(b))
    cer = F.when(F.col("characters") == 0, (F.col("character_edits") > 0).cast("double")).otherwise(ratio("character_edits", "characters"))
    return sums.withColumns({"cer": cer, "empty_ratio": ratio("empty_predictions", "samples"), "length_ratio": ratio("predicted_characters", "reference_characters"), "blank_ratio": ratio("blank_timesteps", "valid_timesteps")})


def pair_figures(rows: DataFrame) -> DataFrame:
    """One row: accuracy, mean cross-entropy and number of pairs (logit, label); 0 of nothing."""
    x, y = F.col("logit"), F.col("label")
    loss = F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
    got = rows.agg(F.avg(((x >= 0).cast("int") == y).cast("double")).alias("accuracy"), F.avg(loss).alias("loss"), F.count("*").alias("pairs"))
    return got.na.fill(0.0, ["accuracy", "loss"])


def calibration_points(samples: DataFrame) -> DataFrame:
    """(confidence, accuracy) of samples (uncalibrated_confidence, cer) that have both; accuracy is 1 - CER within 0 and 1."""
    usable = samples.where("uncalibrated_confidence is not null and cer is not null")
    return usable.select(F.col("uncalibrated_confidence").cast("double").alias("confidence"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("cer"))).alias("accuracy"))


def capacity(lines: DataFrame) -> DataFrame:
    """One row on whether lines fit their decoder: least margin, greatest needs, failures and the first of them (by ord).

    ``lines``: ord, id, required (steps), height, width, capped. Four pixels of width make one step, at least one.
    """
    available = F.greatest(F.lit(1), F.floor(F.col("width") / 4).cast("long"))
    each = lines.withColumn("available", available).withColumn("margin", F.col("available") - F.col("required"))
    bad = F.col("margin") < 0
    return each.agg(
        F.count("*").alias("samples"), F.count_if(bad).alias("failures"), F.min("margin").alias("min_margin"), F.max("required").alias("max_required"), F.max("available").alias("max_available"), F.count_if("capped").alias("width_capped"),
        F.min("height").alias("min_height"), F.max("height").alias("max_height"), F.min("width").alias("min_width"), F.max("width").alias("max_width"), F.min_by("id", F.when(bad, F.col("ord"))).alias("first_failure"),
    )


def line_report(pairs: DataFrame, detail: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """(summary, lines) of recognized lines (id, reference, hypothesis, seconds): counts and rates of normalized texts; without ``detail`` no line is kept."""
    from quillforge.operators.metrics import edit_columns, rate

    norm = pairs.withColumns({"reference": tx.normalize_text(F.col("reference")), "hypothesis": tx.normalize_text(F.col("hypothesis"))})
    each = edit_columns(norm).withColumns({"exact": F.col("reference") == F.col("hypothesis"), "empty": F.col("hypothesis") == ""})
    summary = each.agg(F.count("*").alias("samples"), rate("char_edits", "n_chars", "h_chars").alias("cer"), rate("word_edits", "n_words", "h_words").alias("wer"), F.avg(F.col("exact").cast("double")).alias("exact_ratio"), F.count_if("empty").alias("empty"), F.sum("seconds").alias("seconds"))
    return summary, each if detail else None


# --- bundles, queues, sessions -------------------------------------------------------------------------------------------

#: Kinds of reports in the order of a bundle, and what its summary takes from each (path in the report).
REPORTS = {
    "ocr": {"samples": "$.overall.samples", "cer": "$.overall.cer", "wer": "$.overall.wer"},
    "recognizer": {"samples": "$.overall.samples", "cer": "$.overall.cer", "wer": "$.overall.wer"},
    "layout": {k: f"$.metrics.{k}" for k in ("block_f1", "mean_iou", "block_type_accuracy", "reading_order_accuracy", "table_cell_f1")},
    "docx": {k: f"$.metrics.{k}" for k in ("composite_score", "pixel_similarity", "foreground_iou", "edge_f1", "page_count_score")},
}


def number_at(text: Column, path: str) -> Column:
    """A number of a JSON text as a double; null where it is missing or of another kind."""
    value = F.try_variant_get(F.try_parse_json(text), path, "variant")
    kind = F.schema_of_variant(value)
    return F.when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.try_variant_get(F.try_parse_json(text), path, "double"))


def bundle(reports: DataFrame) -> DataFrame:
    """(place, kind, file, sha256, schema_version, metric, value) of reports (kind, file, content), kinds in their fixed order; unknown kinds have no place and no metric."""
    kinds = list(REPORTS)
    place = F.coalesce(*(F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(kinds)))
    pick = F.coalesce(*(F.when(F.col("kind") == k, F.array(*(F.struct(F.lit(m).alias("metric"), number_at(F.col("content"), p).alias("value")) for m, p in REPORTS[k].items()))) for k in kinds))
    version = F.coalesce(F.get_json_object("content", "$.schema_version"), F.lit("unknown"))
    head = reports.select(place.alias("place"), "kind", "file", F.sha2("content", 256).alias("sha256"), version.alias("schema_version"), F.explode_outer(pick).alias("m"))
    return head.select("place", "kind", "file", "sha256", "schema_version", "m.metric", "m.value")


def queue_summary(entries: DataFrame) -> DataFrame:
    """One row: entries of a review queue and those with problems."""
    return entries.agg(F.count("*").alias("sample_count"), F.count_if(F.size("problems") > 0).alias("with_problems"))


def session_progress(pages: DataFrame, files: DataFrame) -> DataFrame:
    """State of each page (page, ...) of a capture session from its files (page, name): pending, complete with the file's name, or duplicate."""
    found = files.groupBy("page").agg(F.count("*").alias("n"), F.min("name").alias("name"))
    n = F.coalesce("n", F.lit(0))
    return pages.join(found, "page", "left").withColumn("state", F.when(n > 1, "duplicate").when(n == 1, "complete").otherwise("pending")).withColumn("capture_file", F.when(n == 1, F.col("name"))).drop("n", "name")


def session_totals(progress: DataFrame) -> DataFrame:
    done = F.count_if(F.col("state") == "complete")
    return progress.agg(F.count("*").alias("expected"), done.alias("completed"), (F.count("*") - done).alias("remaining"))


def suite_samples(packs: DataFrame, subsets: dict[str, str]) -> DataFrame:
    """Quality-check samples of the pages of capture packs (suite, template, page, image, ground_truth, sha256, tags): all in the test split, marked as digital."""
    names = F.create_map(*(x for k, v in subsets.items() for x in (F.lit(k), F.lit(v))))
    marks = F.array(F.lit("qa:digital-capture-suite"), F.lit("source:digital-capture-suite"))
    return packs.select(F.col("page").alias("id"), F.col("page").alias("document_id"), F.lit("test").alias("split"), F.coalesce(F.try_element_at(names, F.col("template")), F.lit("other")).alias("subset"), F.col("image").alias("source"), "ground_truth", "sha256", F.concat("tags", marks).alias("tags"))


def template_counts(samples: DataFrame) -> DataFrame:
    """(template, n) from tags that start with "template:"."""
    tags = samples.select(F.explode("tags").alias("t")).where(F.col("t").startswith("template:"))
    return tags.groupBy(F.substring_index("t", ":", -1).alias("template")).agg(F.count("*").alias("n"))
