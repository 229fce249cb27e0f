"""Small values of the service and of generated samples: names, keys, sizes, profiles, timestamps, confidences."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillforge.functions.draws import first_draws
from quillforge.functions.text import LAO

# --- shards ---------------------------------------------------------------------------------------------------------------


def quality_bin(url: Column) -> Column:
    """The number before the first _ of a file name; -1 where that is no number."""
    head = F.substring_index(F.substring_index(url, "/", -1), "_", 1)
    return F.when(head.rlike(r"^\d{1,9}\z"), F.expr("0") + F.try_to_number(head, F.lit("999999999")).cast("int")).otherwise(F.lit(-1))


def checksum_url(url: Column) -> Column:
    """Where the checksum of a shard lies: a hidden file beside a compressed JSONL shard, else its name with .md5."""
    name = F.substring_index(url, "/", -1)
    folder = F.left(url, F.char_length(url) - F.char_length(name))
    return F.when(name.endswith(".jsonl.zst"), F.concat(folder, F.lit("."), F.regexp_replace(name, r"\.zst$", ""), F.lit(".md5"))).otherwise(F.concat(url, F.lit(".md5")))


def shard_map(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shards, violations) of a map of shards (pos, line): best quality bin first, then the greatest URL. An empty map and URLs that aren't HTTPS are violations."""
    urls = lines.select("pos", F.trim("line").alias("url")).where("url <> ''")
    odd = urls.where(~F.col("url").startswith("https://")).select("url", F.lit("not HTTPS").alias("problem"))
    none = urls.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(None).cast("string").alias("url"), F.lit("empty map").alias("problem"))
    good = urls.where(F.col("url").startswith("https://")).withColumn("quality", quality_bin(F.col("url")))
    return good.orderBy(F.desc("quality"), F.desc("url")), odd.unionByName(none)


# --- language model keys, page ids, capture pages ---------------------------------------------------------------------------


def context_key(ids: Column) -> Column:
    """Token ids as a key: joined by commas, empty for the empty context."""
    return F.array_join(F.transform(ids, lambda i: i.cast("string")), ",")


def parse_context_key(key: Column) -> Column:
    empty = F.array().cast("array<int>")
    return F.when(key == "", empty).otherwise(F.transform(F.split(key, ","), lambda p: p.cast("int")))


def page_payload(page: Column, prefix: str) -> Column:
    """What a page's mark says: the prefix and the trimmed id; null for an empty id."""
    return F.when(F.trim(page) != "", F.concat(F.lit(prefix), F.trim(page)))


def payload_page(payload: Column, prefix: str) -> Column:
    """The id in a mark's text; null for other texts and empty ids."""
    rest = F.trim(F.substring(payload, len(prefix) + 1, 10**6))
    return F.when(payload.startswith(prefix) & (rest != ""), rest)


def amount(row: Column) -> Column:
    """The amount in row ``row`` (from 0) of a generated table: (row + 1) * 5000 with grouping commas and the kip sign."""
    return F.concat(F.format_number((row + 1) * 5000, 0), F.lit(" ₭"))


def page_language(text: Column, other: bool = False) -> Column:
    """language:mixed, :lao or :latin by the letters of a page; language:other (or null) for neither."""
    lao, latin = text.rlike(f"[{LAO}]"), text.rlike("[A-Za-z]")
    return F.when(lao & latin, "language:mixed").when(lao, "language:lao").when(latin, "language:latin").otherwise(F.lit("language:other" if other else None))


#: What a template's pages are tagged with beside the template itself.
TEMPLATE_TAGS = {
    "plain": ["layout:plain"],
    "two-column": ["layout:multi-column"],
    "ruled-table": ["content:table", "layout:table", "table:ruled"],
    "borderless-table": ["content:table", "layout:table", "table:borderless"],
    "receipt": ["document:receipt", "layout:receipt"],
    "form": ["document:form", "layout:form"],
}


def template_tags(template: Column, text: Column) -> Column:
    """Sorted tags of a page made from a template."""
    own = F.coalesce(*(F.when(template == t, F.array(*map(F.lit, tags))) for t, tags in TEMPLATE_TAGS.items()), F.array().cast("array<string>"))
    every = F.concat(F.array(F.lit("source:capture-pack"), F.lit("page-id:qr-v1"), F.concat(F.lit("template:"), template), page_language(text, True)), own)
    return F.array_sort(F.array_distinct(every))


def plain_page_tags(text: Column) -> Column:
    """Sorted tags of a plain page: its layout, its source and its language, if letters tell."""
    return F.array_sort(F.array_compact(F.array(F.lit("layout:plain"), F.lit("source:capture-pack"), page_language(text))))


# --- generated samples ------------------------------------------------------------------------------------------------------


def font_sizes(least: Column, most: Column) -> Column:
    """Sizes from ``least`` to ``most`` in about four steps, both ends included; null below 8 or where they are out of order."""
    step = F.greatest(F.lit(1), F.ceil((most - least) / 4).cast("int"))
    ladder = F.sequence(least, most, step)
    whole = F.when(F.element_at(ladder, -1) == most, ladder).otherwise(F.concat(ladder, F.array(most)))
    return F.when((least >= 8) & (most >= least), F.when(least == most, F.array(least)).otherwise(whole))


#: The profiles of a balanced mixture in turn, and the limits of each profile's distortions.
BALANCED = ("clean-scan", "noisy-scan", "phone-photo")
PROFILE_FIELDS = ("max_rotation_degrees", "noise_std", "blur_radius", "brightness_jitter", "contrast_jitter", "perspective_jitter", "shadow_strength", "min_scale", "jpeg_quality_min", "jpeg_quality_max")
PROFILES = {
    "clean-scan": (0.45, 1.5, 0.15, 0.03, 0.04, 0.0, 0.0, 0.9, 92, 100),
    "noisy-scan": (2.0, 8.0, 0.75, 0.12, 0.16, 0.0, 0.06, 0.6, 55, 90),
    "phone-photo": (3.0, 5.0, 0.6, 0.15, 0.12, 0.045, 0.2, 0.72, 65, 95),
}


def profiles(spark: SparkSession) -> DataFrame:
    """The profiles as a dimension table."""
    kinds = ", ".join(f"{f} {'int' if f.startswith('jpeg') else 'double'}" for f in PROFILE_FIELDS)
    return spark.createDataFrame([(k, *v) for k, v in PROFILES.items()], f"profile string, {kinds}")


def profile_of(requested: Column, sample: Column) -> Column:
    """The profile of a sample: a balanced mixture takes them in turn."""
    return F.when(requested == "balanced", F.get(F.array(*map(F.lit, BALANCED)), F.pmod(sample, F.lit(len(BALANCED))).cast("int"))).otherwise(requested)


def font_index(requested: Column, sample: Column, line: Column, variant: Column, fonts: Column) -> Column:
    """Which font a sample takes: in turn by line and variant; in a balanced mixture so that profiles and fonts mix."""
    n = F.lit(len(BALANCED))
    mixed = F.floor(sample / n) + F.pmod(sample, n)
    return F.pmod(F.when(requested == "balanced", mixed).otherwise(line + variant), fonts).cast("int")


DRAW = "angle double, brightness double, contrast double, blur double, noise_std double"


def seeded_draws(samples: DataFrame) -> DataFrame:
    """``samples`` (seed, and the limits of ``PROFILE_FIELDS``) with the first five parameters that numpy's generator draws for the seed.

    The generators of a whole batch are run side by side (``draws.first_draws``). A seed that is null or below 0 has no draws.
    """

    @F.pandas_udf(DRAW)
    def draw(seed: pd.Series, rotation: pd.Series, brightness: pd.Series, contrast: pd.Series, blur: pd.Series, noise: pd.Series) -> pd.DataFrame:
        good = (seed.notna() & (seed >= 0)).to_numpy()
        u = np.full((len(seed), 5), np.nan)
        u[good] = first_draws(seed[good].to_numpy(np.uint64), 5)
        low = np.stack([-rotation, 1 - brightness, 1 - contrast, 0 * blur, 0 * noise], 1)
        high = np.stack([rotation, 1 + brightness, 1 + contrast, blur, noise], 1)
        return pd.DataFrame(low + (high - low) * u, columns=[c.split()[0] for c in DRAW.split(", ")])

    usable = F.col("seed").isNotNull() & (F.col("seed") >= 0)
    return samples.withColumn("draw", draw("seed", "max_rotation_degrees", "brightness_jitter", "contrast_jitter", "blur_radius", "noise_std")).withColumn("draw", F.when(usable, F.col("draw")))


# --- the service ------------------------------------------------------------------------------------------------------------


def request_id(supplied: Column, fresh: Column) -> Column:
    """The id that a request brings, if it is one (letters, digits, ._- and at most 128), else a fresh one."""
    mine = F.trim(F.coalesce(supplied, F.lit("")))
    return F.when(mine.rlike(r"^[\p{L}\p{N}._\-]{1,128}\z"), mine).otherwise(fresh)


def client_key(forwarded: Column, host: Column, trusted: bool) -> Column:
    """Who a request counts for: the first forwarded address where proxies are trusted, else the host, else unknown; at most 128 characters."""
    first = F.trim(F.substring_index(F.coalesce(forwarded, F.lit("")), ",", 1))
    own = F.when(F.coalesce(host, F.lit("")) != "", F.left(host, F.lit(128))).otherwise("unknown")
    return F.when(F.lit(trusted) & (first != ""), F.left(first, F.lit(128))).otherwise(own)


def utc_stamp(moment: Column) -> Column:
    """A timestamp as ISO 8601 in UTC with microseconds where there are any (the session's zone is UTC)."""
    whole = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")
    part = F.pmod(F.unix_micros(moment), F.lit(1_000_000))
    return F.concat(whole, F.when(part == 0, "").otherwise(F.concat(F.lit("."), F.lpad(part.cast("string"), 6, "0"))), F.lit("+00:00"))


def beam_confidence(log_p: Column, steps: Column) -> Column:
    """The mean probability of a step, within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.exp(log_p / F.greatest(F.lit(1), steps))))


def greedy_confidence(lattice: Column) -> Column:
    """The mean of the steps' greatest probabilities (``lattice``: arrays of log probabilities); 0 without steps."""
    best = F.transform(lattice, lambda step: F.exp(F.array_max(step)))
    total = F.aggregate(best, F.lit(0.0), lambda acc, p: acc + p)
    return F.when(F.size(lattice) == 0, F.lit(0.0)).otherwise(total / F.greatest(F.lit(1), F.size(lattice)))


def page_sample(count: Column, most: Column, requested: Column | None = None) -> Column:
    """Pages to look at, at most ``most``: those requested, each once and in their order (null if one is out of range); else the first, the middle and the last, filled up from the front, in order."""
    ends = F.when((most == 1) | (count == 1), F.array(F.lit(1))).when(most == 2, F.array(F.lit(1), count))
    three = F.array_distinct(F.array(F.lit(1), F.ceil(count / 2).cast("int"), count))
    filled = F.slice(F.array_distinct(F.concat(three, F.sequence(F.lit(1), count))), 1, F.least(most, count))
    own = F.when((count >= 1) & (most >= 1), F.coalesce(ends, F.array_sort(filled)))
    if requested is None:
        return own
    asked = F.array_distinct(requested)
    fine = F.forall(asked, lambda p: (p >= 1) & (p <= count))
    return F.when(F.size(F.coalesce(requested, F.array().cast("array<int>"))) == 0, own).when(fine & (most >= 1), F.slice(asked, 1, F.greatest(F.lit(1), most)))


def url_problem(url: Column) -> Column:
    """Why a URL is not to be fetched: not HTTPS, no host, user info, another port, or an address that isn't public written as its host; null if nothing speaks against it (names aren't resolved)."""
    host, authority = F.lower(F.try_parse_url(url, F.lit("HOST"))), F.try_parse_url(url, F.lit("AUTHORITY"))
    port = F.regexp_extract(authority, r":(\d*)$", 1)
    private = host.rlike(r"^(0|10|127)\.|^169\.254\.|^192\.168\.|^172\.(1[6-9]|2\d|3[01])\.|^(22[4-9]|23\d|24\d|25[0-5])\.|^\[(::1?|f[cd].*|fe[89ab].*|ff.*)\]$")
    return (
        F.when(~F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))) == "https", F.lit(False)), "not HTTPS")
        .when(F.coalesce(host, F.lit("")) == "", "no host")
        .when(F.coalesce(F.contains(authority, F.lit("@")), F.lit(False)), "user info")
        .when(~port.isin("", "443"), "another port")
        .when(private, "not a public address")
    )


def mapping(values: dict) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(values.items())))
