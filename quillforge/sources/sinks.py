"""Rendering and writing: plain text, Markdown, JSON, JSONL manifests, text corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plain_text(pages: Column) -> Column:
    """Blocks by line ends, pages by an empty line; empty texts are skipped. ``pages``: arrays of blocks with a text."""
    page = lambda blocks: F.array_join(F.filter(F.transform(blocks, lambda b: b["text"]), lambda t: t != ""), "\n")
    return F.array_join(F.transform(pages, page), "\n\n")


def markdown(blocks: Column, page: Column | None = None) -> Column:
    """One page: headings with one to six # (line ends read as blanks), list items numbered or with dashes by their style, other texts as they are.

    An empty line stands between, blocks without text go. ``blocks``: type, level, text, and where they have them items and list_style.
    ``page`` (a number) puts a comment before the page, as documents of several pages have.
    """

    def one(b: Column) -> Column:
        marks = F.repeat(F.lit("#"), F.least(F.lit(6), F.greatest(F.lit(1), F.coalesce(b["level"], F.lit(1)))))
        items = F.when(F.size(F.coalesce(b["items"], F.array().cast("array<string>"))) > 0, b["items"]).otherwise(F.split(F.regexp_replace(b["text"], "\n$", ""), "\n"))
        listed = F.transform(items, lambda t, i: F.when(b["list_style"] == "ordered", F.concat((i + 1).cast("string"), F.lit(". "), t)).when(b["list_style"] == "bullet", F.concat(F.lit("- "), t)).otherwise(t))
        alone = F.when(F.coalesce(b["text"], F.lit("")) != "", F.array(b["text"])).otherwise(F.array().cast("array<string>"))
        return F.when(b["type"] == "heading", F.array(F.concat(marks, F.lit(" "), F.translate(b["text"], "\n", " ")))).when(b["type"] == "list", listed).otherwise(alone)

    parts = F.flatten(F.transform(blocks, one))
    if page is not None:
        parts = F.concat(F.array(F.concat(F.lit("<!-- Page "), page.cast("string"), F.lit(" -->"))), parts)
    return F.concat(F.regexp_replace(F.array_join(parts, "\n\n"), r"(?U)^\s+|\s+$", ""), F.lit("\n"))


def markdown_document(pages: Column) -> Column:
    """Pages in order (number, blocks): comments before them if there are several, an empty line and the gap of an empty part between."""
    several = F.size(pages) > 1
    page = lambda p: F.regexp_replace(F.when(several, markdown(p["blocks"], p["number"])).otherwise(markdown(p["blocks"])), "\n$", "")
    return F.concat(F.regexp_replace(F.array_join(F.transform(pages, page), "\n\n\n\n"), r"(?U)^\s+|\s+$", ""), F.lit("\n"))


def write_lines(rows: DataFrame, path: str, line: str = "line", order: tuple[str, ...] = ("doc_id", "pos")) -> None:
    """Lines in order, as part files whose order is that of the lines."""
    rows.orderBy(*order).select(F.col(line).alias("value")).write.text(path)


def write_jsonl(rows: DataFrame, path: str, order: tuple[str, ...] = ()) -> None:
    (rows.orderBy(*order) if order else rows).write.json(path)


def report_json(rows: DataFrame) -> DataFrame:
    """Each row as one JSON text; null fields are left out."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "true"}).alias("value"))


def indented_json(rows: DataFrame) -> DataFrame:
    """Each row as a report: JSON with an indent of two, other scripts as they are, a line end at the end."""
    return rows.select(F.concat(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false", "pretty": "true"}), F.lit("\n")).alias("value"))


def corpus_text(lines: DataFrame, key: str, order: str, line: str = "line") -> DataFrame:
    """(key, text) of small corpora: lines in order, a line end at the end unless there is nothing."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda s: s[line]), "\n")
    return lines.groupBy(key).agg(joined.alias("t")).select(key, F.when(F.col("t") == "", "").otherwise(F.concat("t", F.lit("\n"))).alias("text"))


def append_jsonl(rows: DataFrame, path: str, key: str = "id") -> DataFrame:
    """Append samples to a JSONL manifest all or none: with a key twice, or one that the manifest has already, nothing is written and the keys come back.

    The write is one Spark job, whose files appear when it commits; a job that fails leaves none.
    """
    spark = rows.sparkSession
    twice = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    try:
        there = spark.read.json(path).select(F.col(key).cast(dict(rows.dtypes)[key]).alias(key))
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNRESOLVED_COLUMN" not in str(e):
            raise
        there = None
    bad = twice if there is None else twice.unionByName(rows.select(key).join(there, key, "left_semi")).distinct()
    if bad.isEmpty():
        rows.write.mode("append").json(path)
    return bad


def write_manifest(rows: DataFrame, path: str, key: str = "id") -> None:
    """A JSONL manifest in order of its key, keys of each line sorted."""
    rows.select(*sorted(rows.columns)).orderBy(key).write.option("ignoreNullFields", "false").json(path)


def vocabulary_json(vocab: DataFrame) -> DataFrame:
    """One JSON text with the characters of a vocabulary (char, id) in order of their ids; a vocabulary is bounded by the code points there are."""
    chars = F.transform(F.array_sort(F.collect_list(F.struct("id", "char"))), lambda s: s["char"])
    return vocab.agg(F.to_json(F.struct(F.lit("1").alias("version"), chars.alias("characters"))).alias("value"))


def calibration_json(bins: DataFrame) -> DataFrame:
    """One JSON text with the bins of a calibration in order."""
    fields = ["bin", "points", "low", "high", "mean_confidence", "accuracy"]
    return bins.agg(F.to_json(F.struct(F.lit("1").alias("version"), F.array_sort(F.collect_list(F.struct(*fields))).alias("bins"))).alias("value"))


def escaped_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def queue_cards(entries: DataFrame) -> DataFrame:
    """Entries of a review queue (id, status, subset, text, problems) as HTML cards in order of status, subset and id."""
    safe = lambda c: escaped_html(F.coalesce(F.col(c).cast("string"), F.lit("")))
    problems = F.array_join(F.transform("problems", lambda p: F.concat(F.lit("<li>"), escaped_html(p), F.lit("</li>"))), "")
    card = F.concat(F.lit('<article id="'), safe("id"), F.lit('"><h2>'), safe("id"), F.lit("</h2><p>"), safe("status"), F.lit(" / "), safe("subset"), F.lit("</p><pre>"), safe("text"), F.lit("</pre>"), F.when(F.size("problems") > 0, F.concat(F.lit("<ul>"), problems, F.lit("</ul>"))).otherwise(""), F.lit("</article>"))
    return entries.select("status", "subset", "id", card.alias("html")).orderBy("status", "subset", "id")


def write_queue(entries: DataFrame, path: str) -> None:
    """A review queue as JSON lines, CSV (lists joined by ;) and HTML, each in order."""
    ordered = entries.orderBy("status", "subset", "id")
    ordered.write.json(f"{path}/queue.json")
    flat = [F.array_join(c, ";").alias(c) if t.startswith("array") else F.col(c) for c, t in entries.dtypes]
    ordered.select(*flat).write.option("header", "true").csv(f"{path}/queue.csv")
    queue_cards(entries).select(F.col("html").alias("value")).write.text(f"{path}/queue.html")
