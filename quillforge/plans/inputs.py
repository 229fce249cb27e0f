"""Inputs that both engines read: one SQL text in the dialect they share, with {table} for a provided table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from quillforge.tables import table

_NAME = re.compile(r"\{(\w+)\}")


def made(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of ``sql`` over the tables under ``sf_dir``."""
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in set(_NAME.findall(sql))})


def duck(sql: str) -> str:
    """``sql`` as a subquery for DuckDB."""
    return "(" + _NAME.sub(r"\1", sql) + ")"


#: Normalized text in DuckDB (of {0}): composed, line ends and blanks collapsed, lines and ends stripped.
FLAT = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize({0}), '\r\n?', chr(10), 'g'), '[\t\x{{00A0}} ]+', ' ', 'g'), '(?m)^ +| +$', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
