"""Ordered folds over small groups: a partition's groups pass through one task in batches, one group held at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def fold(rows: DataFrame, keys: list[str], order: list[str], step: Callable[[tuple, list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """``step(key, rows of the group in order)`` for each group of ``keys``; its tuples have the columns of ``schema``.

    ``rows`` has the keys first; ``step`` gets the other columns. One shuffle by the keys; groups of any number share a task's batches,
    so thousands of small pages cost one call of a function each, not a conversion each. Null keys are one group.
    """
    names, k = _names(schema), len(keys)
    same = lambda a, b: b is not None and all(x == y or (x != x and y != y) for x, y in zip(a, b, strict=True))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: tuple | None = None
        held: list[tuple] = []
        for pdf in batches:
            out: list[tuple] = []
            for row in pdf.itertuples(index=False, name=None):
                if not same(row[:k], key):
                    if held:
                        out.extend(step(key, held))
                    key, held = row[:k], []
                held.append(row[k:])
            yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame(list(step(key, held)), columns=names)

    return rows.select(*keys, *(c for c in rows.columns if c not in keys)).repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def _names(schema: str) -> list[str]:
    """The top-level column names of a schema text."""
    parts, depth, word = [], 0, ""
    for c in schema + ",":
        if c == "," and not depth:
            parts.append(word.split()[0])
            word = ""
            continue
        depth += (c == "<") - (c == ">")
        word += c
    return parts
