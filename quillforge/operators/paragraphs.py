"""From lines to the blocks of a page: paragraphs, headings and lists, tables, and the order of them all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillforge.functions import text as tx
from quillforge.operators.borderless import borderless_tables, remaining
from quillforge.operators.linked import settled
from quillforge.operators.reading import reading_order
from quillforge.operators.tables import region_tables

#: A heading's lines, characters and height over the page's typical one; heights of the first two levels.
HEADING_LINES, HEADING_CHARS, HEADING, LEVELS = 2, 160, 1.30, (1.75, 1.50)
#: Columns of a block.
BLOCK = ("page", "page_width", "type", "level", "text", "items", "list_style", "confidence", "x", "y", "w", "h")


def heading_level(ratio: Column) -> Column:
    """Level by height over the page's median line height."""
    return F.when(ratio >= LEVELS[0], 1).when(ratio >= LEVELS[1], 2).otherwise(3)


def is_heading(lines: Column, chars: Column, ratio: Column) -> Column:
    return (lines <= HEADING_LINES) & (chars <= HEADING_CHARS) & (ratio >= HEADING)


def paragraph_blocks(lines: DataFrame) -> DataFrame:
    """Blocks from lines: page, page_width, block, paragraph, line, text, confidence, x, y, w, h and hint (or null).

    Texts are normalized; paragraphs without text go. Lines that all begin or go on with items of one style are a list; few,
    short and tall ones a heading; others a paragraph. A hint counts where a paragraph has one only: it makes a heading, a list (of
    lines, style unresolved) or a table of what is neither list nor table, and never undoes a heading.
    """
    one = F.struct("line", F.col("text").alias("raw"), tx.normalize_text(F.col("text")).alias("text"), F.col("h"))
    x, y = F.min("x"), F.min("y")
    box = {"x": x, "y": y, "w": F.max(F.col("x") + F.col("w")) - x, "h": F.max(F.col("y") + F.col("h")) - y}
    grouped = lines.groupBy("page", "block", "paragraph").agg(
        F.array_sort(F.collect_list(one)).alias("parts"), F.median("h").alias("height"), F.avg("confidence").alias("mean"), F.collect_set("hint").alias("hints"), F.max("page_width").alias("page_width"), *(c.alias(k) for k, c in box.items())
    )
    typical = lines.groupBy("page").agg(F.median("h").alias("typical"))
    found = grouped.join(typical, "page").withColumns(
        {
            "texts": F.filter(F.transform("parts", lambda p: p["text"]), lambda t: t != ""),
            "text": tx.normalize_text(F.array_join(F.transform("parts", lambda p: p["raw"]), "\n")),
            "ratio": F.col("height") / F.greatest(F.lit(1.0), F.col("typical")),
            "hint": F.when(F.size("hints") == 1, F.get("hints", F.lit(0))),
            "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("mean"))),
        }
    )
    found = found.where(F.col("text") != "").withColumn("own_items", tx.list_items(F.col("texts")))
    listed = F.col("own_items").isNotNull()
    headed = ~listed & is_heading(F.size("parts"), F.char_length(tx.tidy(F.array_join("texts", "\n"))), F.col("ratio"))
    kind = F.when(listed, "list").when(F.col("hint").isin("heading", "list", "table"), F.col("hint")).when(headed, "heading").otherwise("paragraph")
    items = F.when(listed, F.col("own_items")).when(F.col("type") == "list", F.col("texts"))
    style = F.when(listed, tx.list_style(F.col("texts"))).when(F.col("type") == "list", "unresolved")
    level = F.when(F.col("type") == "heading", heading_level(F.col("ratio")))
    return found.withColumn("type", kind).withColumns({"items": items, "list_style": style, "level": level}).select("block", "paragraph", *BLOCK, F.col("ratio").alias("height_ratio"))


def concatenated(*sources: DataFrame) -> DataFrame:
    """Blocks of several detectors, with the place of their source (blocks of equal place on the page keep this order)."""
    slim = [s.select(*(F.col(c) if c in s.columns else F.lit(None).alias(c) for c in BLOCK), F.lit(i).alias("source")) for i, s in enumerate(sources)]
    return reduce(DataFrame.unionByName, slim)


def page_blocks(lines: DataFrame, ruled: DataFrame | None = None) -> DataFrame:
    """All blocks of pages in reading order (place from 1): ruled tables, tables of hinted regions, aligned tables, then what is left as paragraphs.

    ``lines`` as for ``paragraph_blocks`` plus ord, unique on a page. ``ruled`` has blocks of type table with ``lines``, the ords they take.
    """
    ruled = None if ruled is None else settled(ruled)  # every detector's tables are read by the next ones and by the result
    left = settled(lines if ruled is None else remaining(lines, ruled))
    hinted = settled(region_tables(left.where(F.col("hint") == "table")))
    left = settled(remaining(left, hinted))
    aligned = settled(borderless_tables(left))
    left = remaining(left, aligned)
    width = lines.groupBy("page").agg(F.max("page_width").alias("page_width"))
    table = lambda t: t.withColumn("type", F.lit("table")).drop("page_width").join(width, "page")
    every = concatenated(paragraph_blocks(left), *([table(ruled)] if ruled is not None else []), table(hinted), table(aligned))
    number = F.xxhash64("source", "type", "text", "x", "y", "w", "h").bitwiseAND((1 << 40) - 1)  # unique within a page but for equal blocks
    every = settled(every.withColumn("ord", F.col("source") * F.lit(1 << 40) + number))
    placed = reading_order(every).groupBy("page", "ord").agg(F.min("place").alias("place"))
    return every.join(placed, ["page", "ord"]).drop("ord")


#: Bands at the top and bottom of a page, and the share of pages on which a text must stand there.
BAND, PAGES = 0.12, 0.6


def bands(blocks: DataFrame, margin: float = BAND) -> DataFrame:
    """``blocks`` (document, page, page_height, type, text, y, h, ...) with their normalized text and whether they reach the top or bottom band; tables and images never do."""
    plain = F.when(F.col("type").isin("table", "image"), "").otherwise(tx.normalize_text(F.col("text")))
    usable = (F.col("plain") != "") & F.col("y").isNotNull()
    top = F.col("y") <= F.col("page_height") * margin
    bottom = F.col("y") + F.col("h") >= F.col("page_height") * (1 - margin)
    return blocks.withColumn("plain", F.coalesce(plain, F.lit(""))).withColumns({"at_top": F.coalesce(usable & top, F.lit(False)), "at_bottom": F.coalesce(usable & bottom, F.lit(False))})


def with_roles(blocks: DataFrame, margin: float = BAND, share: float = PAGES) -> DataFrame:
    """``blocks`` with role: header or footer where the text stands in that band on max(2, ceil(share * pages)) pages or more; header first."""
    placed = bands(blocks, margin)
    pages = placed.groupBy("document").agg(F.countDistinct("page").alias("pages"))
    count = lambda flag, name: F.countDistinct(F.when(F.col(flag), F.col("page"))).alias(name)
    seen = placed.where("at_top or at_bottom").groupBy("document", "plain").agg(count("at_top", "tops"), count("at_bottom", "bottoms"))
    need = F.greatest(F.lit(2), F.floor(F.col("pages") * share + 0.999999))
    repeated = seen.join(pages, "document").select("document", "plain", (F.col("tops") >= need).alias("heads"), (F.col("bottoms") >= need).alias("feet"))
    role = F.when(F.col("heads") & F.col("at_top"), "header").when(F.col("feet") & F.col("at_bottom"), "footer")
    return placed.join(repeated, ["document", "plain"], "left").withColumn("role", role).drop("plain", "at_top", "at_bottom", "heads", "feet")


def role_texts(blocks: DataFrame, role: str) -> DataFrame:
    """(document, texts): distinct normalized texts of a role in the order they first appear (page, ord)."""
    plain = tx.normalize_text(F.col("text"))
    first = blocks.where(F.col("role") == role).groupBy("document", plain.alias("plain")).agg(F.min(F.struct("page", "ord")).alias("at")).where("plain <> ''")
    return first.groupBy("document").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "plain"))), lambda s: s["plain"]).alias("texts"))
