"""Hashes that decide and identify: splits, slots, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest_fraction(key: Column) -> Column:
    """The first eight bytes of the SHA-256 of a key, as a share of 2 ** 64."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("double") / F.lit(18446744073709551616.0)


def stable_split(key: Column, train: float = 0.8, dev: float = 0.1) -> Column:
    share = digest_fraction(key)
    return F.when(share < train, "train").when(share < train + dev, "development").otherwise("test")


def group_slot(key: Column, slots: int = 10_000) -> Column:
    """The first four digest bytes modulo ``slots``."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") % slots


def lock_slot(key: Column, slots: int = 64) -> Column:
    return F.conv(F.substring(F.sha2(key, 256), -8, 8), 16, 10).cast("long") % slots


def framed(text: Column) -> Column:
    """A text's bytes behind their number in eight bytes, big end first."""
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(text)), 16, "0")), F.encode(text, "UTF-8"))


def json_array(*values: Column) -> Column:
    """Strings as a compact JSON array, other scripts as they are."""
    return F.concat(F.lit("["), F.concat_ws(",", *(F.to_json(F.array(v.cast("string"))).substr(F.lit(2), F.char_length(F.to_json(F.array(v.cast("string")))) - 2) for v in values)), F.lit("]"))


def set_fingerprint(texts: Column) -> Column:
    """SHA-256 over the framed distinct texts in code-point order (``texts``: an aggregated array)."""
    return F.sha2(F.aggregate(F.array_sort(F.array_distinct(texts)), F.lit(b""), lambda acc, t: F.concat(acc, framed(t))), 256)


def reference(*values: Column) -> Column:
    """An opaque name of a tuple."""
    return F.sha2(F.to_json(F.array(*(v.cast("string") for v in values))), 256)


def is_sha256(value: Column) -> Column:
    return F.lower(value).rlike("^[0-9a-f]{64}$")
