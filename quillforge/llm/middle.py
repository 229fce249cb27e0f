"""Fill-in-middle transformation by relational units, in DataFrame functions only.

A text is matched into units: blanks with the word after them, or trailing blanks. The matches' lengths are posexploded to
rows (document, ordinal, length) beside the document's cut requests, which are rows (document, ordinal) without a length. Running sums of
the lengths, over a window in order of ordinal, give every request the place in the text where its unit ends: sorted by
ordinal, requests and units join as in a merge join. An aggregate brings a document's two places
into one row, and the text is cut there with substring.

Units of a long document lie in blocks of ``BLOCK``, which have running sums of their own, so no window partition grows
with a text. Only documents that are cut travel: once, with their text in one row and their units' lengths in arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The unit pattern and the marks of prefix, suffix and middle.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE, SPM, SEED = 50, 80, 42
BLOCK = 4096


def draw(doc_id: Column, i: int, seed: int = SEED) -> Column:
    """The i-th (from 1) of eight 32-bit numbers that the seed and the decimal id give."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256)
    return F.conv(F.substring(digest, 8 * i - 7, 8), 16, 10).cast("long")


def form_of(doc_id: Column, text: Column, rate: int = RATE, spm: int = SPM, seed: int = SEED) -> Column:
    """plain, psm or spm; a text without characters, one with a mark in it, and a row without an id stay plain."""
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = doc_id.isNull() | (text == "") | marked | (draw(doc_id, 3, seed) % 100 >= rate)
    return F.when(plain, "plain").when(draw(doc_id, 4, seed) % 100 < spm, "spm").otherwise("psm")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. Marks stand only where they were put, so the output falls into its parts at them."""
    part = F.split(output, "<[PSM]>", -1)
    psm, spm = (F.concat(*(F.get(part, F.lit(i)) for i in order)) for order in ((1, 3, 2), (2, 3, 1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, rate: int = RATE, spm: int = SPM, seed: int = SEED) -> DataFrame:
    """``docs`` plus n (units), form, prefix_chars, middle_chars (code points; null if plain) and output.

    A share of ``rate`` % is cut after two units that the id draws (0 to n), and written prefix first (psm) or, for ``spm`` % of
    them, suffix first. Null and empty texts, texts that hold a mark and rows without a doc_id stay as they are (a null text reads as
    empty). Repeated rows are cut alike. Columns of ``docs`` called like one of the five are replaced, others
    pass through. An empty table gives no rows.
    """
    added = ("n", "form", "prefix_chars", "middle_chars", "output")
    kept = [c for c in docs.columns if c.lower() not in added]
    slim = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.col("doc_id").cast("long").alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body")
    ).withColumn("form", form_of(F.col("doc"), F.col("body"), rate, spm, seed))
    units = F.transform(F.regexp_extract_all("body", F.lit(UNIT), 0), lambda u: F.length(u))
    null = F.lit(None).cast("long")
    plain = slim.where("form = 'plain'").select("row", "body", "form", F.size(units).cast("long").alias("n"), null.alias("p"), null.alias("q"))
    cut = slim.where("form <> 'plain'").withColumn("id", F.monotonically_increasing_id()).withColumn("units", units).withColumn("n", F.size("units").cast("long"))
    one, two = (F.pmod(draw(F.col("doc"), i, seed), F.col("n") + 1) for i in (1, 2))
    cut = cut.select("id", "units", F.struct("row", "body", "form", "n").alias("whole"), F.array(F.least(one, two), F.greatest(one, two)).alias("cuts"))
    # a row for each block of units, with the requests for places in it; the first also carries the document
    last = F.floor((F.size("units") - 1) / BLOCK).cast("int")
    home = lambda c: F.greatest(F.lit(0), F.floor((c - 1) / BLOCK)).cast("int")
    blocks = F.transform(
        F.sequence(F.lit(0), last),
        lambda b: F.struct(
            b.alias("block"),
            F.slice("units", b * BLOCK + 1, BLOCK).alias("lengths"),
            F.filter(F.transform("cuts", lambda c, i: F.struct(c.alias("ordinal"), (i + 1).alias("which"))), lambda r: home(r["ordinal"]) == b).alias("requests"),
            F.when(b == 0, F.col("whole")).alias("whole"),
        ),
    )
    cut = cut.select("id", F.inline(blocks))
    total = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    before = Window.partitionBy("id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("total", total).withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0)))
    # units and requests of a block as rows; a request comes after the unit of its ordinal, ordinal 0 before all
    item = lambda ordinal, which, length, whole: F.struct(ordinal.cast("long").alias("ordinal"), which.cast("int").alias("which"), length.cast("long").alias("length"), whole.alias("whole"))
    nothing = F.when(F.lit(False), F.col("whole"))
    items = F.concat(
        F.transform("lengths", lambda u, i: item(F.col("block") * F.lit(BLOCK).cast("long") + i + 1, F.lit(0), u, nothing)),
        F.transform("requests", lambda r: item(r["ordinal"], r["which"], F.lit(0), nothing)),
        F.array(item(F.lit(-1), F.lit(0), F.lit(0), F.col("whole"))),
    )
    rows = cut.select("id", "block", "base", F.inline(items))
    upto = Window.partitionBy("id", "block").orderBy("ordinal", "which").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.col("base") + F.sum("length").over(upto)).where("which > 0 or whole is not null")
    end = lambda which: F.max(F.when(F.col("which") == which, F.col("end")))
    found = rows.groupBy("id").agg(end(1).alias("p"), end(2).alias("q"), F.first("whole", ignorenulls=True).alias("whole"))
    every = plain.unionByName(found.select("whole.*", "p", "q"))
    head, tail = F.substring("body", F.lit(1), F.col("p").cast("int")), F.substring("body", F.col("q").cast("int") + 1, F.length("body"))
    mid = F.substring("body", F.col("p").cast("int") + 1, (F.col("q") - F.col("p")).cast("int"))
    psm = F.concat(F.lit(PREFIX), head, F.lit(SUFFIX), tail, F.lit(MIDDLE), mid)
    spm_form = F.concat(F.lit(SUFFIX), tail, F.lit(PREFIX), head, F.lit(MIDDLE), mid)
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm_form).otherwise(F.col("body"))
    return every.select(*(F.col(f"row.`{c}`") for c in kept), "n", "form", F.col("p").alias("prefix_chars"), (F.col("q") - F.col("p")).alias("middle_chars"), output.alias("output"))


def middle_query(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the digests of the output and of the text restored from it.

    Awkward rows as ``fill_in_middle`` says; extra columns are dropped.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    done = fill_in_middle(slim)
    digest = lambda c: F.sha2(c, 256)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS h FROM documents
), drawn AS (
  SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
    ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM texts
), formed AS (
  SELECT doc_id, t, units, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parts AS (
  SELECT doc_id, t, n, form, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s FROM formed
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""
