"""Text expressions: normalization, script ratio, edit distance, statistics, small recognizers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Code points of the Lao block, and of Latin letters for tests on other corpora.
LAO = r"\x{0E80}-\x{0EFF}"
LATIN = "A-Za-z"


@F.pandas_udf(T.StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


#: Characters that are composed already, whatever stands beside them (their neighbours in this set included).
_COMPOSED = r"\x{00}-\x{2FF}\x{400}-\x{482}\x{48A}-\x{52F}\x{2010}-\x{2027}\x{2030}-\x{205E}\x{20A0}-\x{20BF}\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}"


def nfc(text: Column) -> Column:
    """Canonical composition. Texts of characters that are composed whatever stands beside them (ASCII among them) are
    seen by the JVM alone: Python is handed a null for them."""
    composed = (F.octet_length(text) == F.char_length(text)) | ~text.rlike(f"[^{_COMPOSED}]")
    return F.when(composed, text).otherwise(_nfc(F.when(~composed, text)))


def tidy(text: Column) -> Column:
    """Line ends to \\n, blanks collapsed and stripped per line, at most one empty line in a row, ends stripped."""
    text = F.regexp_replace(text, "\r\n?", "\n")
    text = F.regexp_replace(text, r"[\t\x{00A0} ]+", " ")
    text = F.array_join(F.transform(F.split(text, "\n", -1), lambda line: F.trim(line)), "\n")
    return F.regexp_replace(F.regexp_replace(text, "\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def normalize_text(text: Column) -> Column:
    return tidy(nfc(text))


def normalize_line(text: Column) -> Column:
    """One line: line ends become blanks first."""
    return normalize_text(F.translate(text, "\r\n", "  "))


def count_of(text: Column, inside: str) -> Column:
    """Characters of a class (the inside of a character class), counted run by run."""
    return F.char_length(text) - F.char_length(F.regexp_replace(text, f"[{inside}]+", ""))


def script_ratio(text: Column, script: str = LAO) -> Column:
    """Share of the letters and digits that belong to ``script`` (inside of a character class); 0 without any."""
    every = count_of(text, rf"\p{{L}}\p{{N}}_{script}")
    return F.when(every == 0, F.lit(0.0)).otherwise(count_of(text, script) / every)


def eligible(text: Column, script: str = LAO, shortest: int = 8, longest: int = 180, least: float = 0.5) -> Column:
    n = F.char_length(text)
    return (n >= shortest) & (n <= longest) & (script_ratio(text, script) >= least)


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def error_rate(edits: Column, length: Column, hypothesis: Column) -> Column:
    """Edits by reference length; an empty reference scores 0 against nothing and 1 against something."""
    return F.when(length == 0, (hypothesis > 0).cast("double")).otherwise(edits / F.when(length == 0, F.lit(1)).otherwise(length))


def char_edits(reference: Column, hypothesis: Column) -> Column:
    return F.levenshtein(reference, hypothesis)


def word_edits(reference: Column, hypothesis: Column) -> Column:
    """Edit distance over words: each distinct word of the pair becomes one character (a pair may hold a million different ones)."""
    both = F.array_distinct(F.concat(words(reference), words(hypothesis)))

    def coded(text: Column) -> Column:
        code = lambda w: F.decode(F.unhex(F.lpad(F.hex(F.lit(0x10000) + F.array_position(both, w)), 8, "0")), "UTF-32")
        return F.array_join(F.transform(words(text), code), "")

    return F.levenshtein(coded(reference), coded(hypothesis))


def text_stats(text: Column, script: str = LAO) -> dict[str, Column]:
    """Counts by kind of character. What ASCII texts can't hold isn't looked for in them."""
    plain = F.octet_length(text) == F.char_length(text)
    rare = lambda inside: F.when(plain, 0).otherwise(count_of(text, inside)).cast("long")
    both = lambda ascii_, inside: F.when(plain, count_of(text, ascii_)).otherwise(count_of(text, inside)).cast("long")
    return {
        "n_chars": F.char_length(text).cast("long"),
        "n_solid": both(r"\S", r"^\s\x{0085}\x{00A0}"),
        "n_words": F.regexp_count(text, F.lit(r"(?U)\S+")).cast("long"),
        "n_lines": F.when(text == "", 0).otherwise(F.char_length(text) - F.char_length(F.translate(text, "\n", "")) + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1)).cast("long"),
        "n_script": both("A-Za-z", script) if script == LATIN else rare(script),
        "n_letters": both("A-Za-z", r"\p{L}"),
        "n_marks": rare(r"\p{M}"),
        "n_digits": both("0-9", r"\p{Nd}"),
        "n_punct": both(r"!-/:-@\[-`{-~", r"\p{P}\p{S}"),
        "n_replaced": rare("\N{REPLACEMENT CHARACTER}"),
    }


def layer_counts(text: Column) -> dict[str, Column]:
    """What two layers of a page are compared by: solid characters, those of the Lao block, Latin letters and other letters."""
    text = F.coalesce(text, F.lit(""))
    solid = F.regexp_replace(text, r"[\s\x{0085}\x{00A0}]+", "")
    lao, latin = count_of(solid, LAO), count_of(solid, r"\p{L}&&\p{IsLatin}")
    other = count_of(F.regexp_replace(solid, rf"[{LAO}\p{{IsLatin}}]+", ""), r"\p{L}")
    return {"solid": F.char_length(solid), "lao": lao, "latin": latin, "other": other}


def text_ratios(stats: dict[str, Column]) -> dict[str, Column]:
    """Shares of ``text_stats``: script, replaced and digit characters among the solid ones; 0 without any."""
    share = lambda n: F.when(stats["n_solid"] == 0, F.lit(0.0)).otherwise(stats[n] / F.when(stats["n_solid"] == 0, F.lit(1)).otherwise(stats["n_solid"]))
    return {"script_share": share("n_script"), "digit_share": share("n_digits"), "replaced_share": share("n_replaced")}


def clusters(text: Column) -> Column:
    """Base characters with the marks that follow; leading marks stand alone."""
    return F.regexp_extract_all(text, F.lit(r"\P{M}\p{M}*|^\p{M}+"), F.lit(0))


#: How list items begin, and what the styles are called.
ORDERED_ITEM, BULLET_ITEM = r"^\d{1,3}[.)]\s+", r"^[\x{2022}\x{25AA}\x{25E6}\x{25CF}*\-]\s+"
ORDERED, BULLET = "ordered", "bullet"


def prefix_style(text: Column) -> Column:
    return F.when(text.rlike(ORDERED_ITEM), ORDERED).when(text.rlike(BULLET_ITEM), BULLET)


def strip_prefix(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{ORDERED_ITEM}|{BULLET_ITEM}", ""))


def list_style(lines: Column) -> Column:
    """The one style of all items (lines without a prefix go on with the item before); null if mixed or if the first has none."""
    styles = F.transform(lines, prefix_style)
    some = F.array_distinct(F.array_compact(styles))
    return F.when(F.get(styles, F.lit(0)).isNotNull() & (F.size(some) == 1), F.get(some, F.lit(0)))


def list_items(lines: Column) -> Column:
    """The items of a list: a line with a prefix opens one, others go on with it; empty items go. Null for what is no list."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, line: Column) -> Column:
        opens = prefix_style(line).isNotNull()
        done = F.when(opens & (acc["open"] != ""), F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(opens, strip_prefix(line)).otherwise(F.trim(F.concat(acc["open"], F.lit(" "), F.trim(line)))).alias("open"))

    items = F.aggregate(lines, start, step, lambda acc: F.when(acc["open"] != "", F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))
    return F.when(list_style(lines).isNotNull() & (F.size(items) > 0), items)


#: Signs and codes of currencies, and what numbers are made of.
CURRENCY, NUMERIC = r"(?iU)[$\x{20AC}\x{00A3}\x{00A5}\x{20AD}]|\b(?:USD|LAK|THB|EUR)\b", r"(?U)^[\d\s.,:/()%+\-]+\z"


def value_like(text: Column) -> Column:
    """Whether a text names a currency, or is a number: a digit, and nothing but digits, blanks and the signs of numbers."""
    plain = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return plain.rlike(CURRENCY) | (plain.rlike(NUMERIC) & plain.rlike(r"(?U)\d"))


#: What a name without anything usable is called, and the longest stem.
UNNAMED, STEM = "document", 120


def safe_filename(name: Column) -> Column:
    """The last path part as a safe name: control characters go, marks stay with the letters of the stem, other signs read _.

    The suffix is what follows the last dot (not at either end), in lower case. Blanks of the stem are collapsed, its ends
    stripped of blanks and dots; an empty stem reads "document".
    """
    base = F.element_at(F.split(F.translate(nfc(F.coalesce(name, F.lit(UNNAMED))), "\\", "/"), "/"), -1)
    base = F.regexp_replace(base, r"(?U)^\s+|\s+$", "")
    suffix = F.regexp_extract(base, r"(?s)^.+(\.[^.]+)$", 1)
    stem = F.left(base, F.char_length(base) - F.char_length(suffix))
    clean = lambda t, kept: F.regexp_replace(F.regexp_replace(t, r"\p{C}", ""), rf"[^{kept}]", "_")
    ends = lambda t: F.regexp_replace(t, r"^[ .]+|[ .]+$", "")
    stem = ends(F.regexp_replace(clean(stem, r"\p{L}\p{M}\p{N} ._\-"), " +", " "))
    stem = F.regexp_replace(F.left(stem, F.lit(STEM)), "[ .]+$", "")
    stem = F.when(stem == "", UNNAMED).otherwise(stem)
    return F.when(base.isin("", ".", ".."), UNNAMED).otherwise(F.concat(stem, clean(F.lower(suffix), r"\p{L}\p{N}._\-")))


def route(path: Column) -> Column:
    """The template of a request path: job numbers read {job_id}; other paths stay as they are."""
    template = F.when(path.rlike(r"^/v1/jobs/[^/]+/download\z"), "/v1/jobs/{job_id}/download").when(path.rlike(r"^/v1/jobs/[^/]+\z"), "/v1/jobs/{job_id}")
    return F.when(path == "/v1/jobs/batch", path).otherwise(F.coalesce(template, path))


def escape_label(value: Column) -> Column:
    for a, b in (("\\", "\\\\"), ("\n", "\\n"), ('"', '\\"')):
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def language_tags(text: Column) -> Column:
    """lao, latin, mixed and digits, as they apply."""
    lao, latin = text.rlike(f"[{LAO}]"), text.rlike("[A-Za-z]")
    flags = F.array(F.when(lao, "lao"), F.when(latin, "latin"), F.when(lao & latin, "mixed"), F.when(text.rlike(r"\d"), "digits"))
    return F.array_compact(flags)


def tags(values: Column) -> Column:
    """Trimmed, lower-cased, distinct, sorted; empty ones go."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(values, lambda t: F.lower(F.trim(t))), lambda t: t != "")))


def safe_relative(path: Column) -> Column:
    parts = F.split(F.translate(path, "\\", "/"), "/")
    return (path != "") & ~path.rlike(r"^([/\\]|[A-Za-z]:)") & ~F.array_contains(parts, "..")
