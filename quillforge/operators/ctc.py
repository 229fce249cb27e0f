"""Label sequences of a recognizer: collapsing, needed steps and prefix beam search."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def collapse(ids: Column, blank: int = 0) -> Column:
    """Labels without repeats and blanks (a blank between equal labels keeps both)."""
    pairs = F.zip_with(ids, F.concat(F.array(F.lit(None).cast("long")), F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0)))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    kept = F.filter(pairs, lambda p: (p["a"] != blank) & (p["b"].isNull() | (p["a"] != p["b"])))
    return F.transform(kept, lambda p: p["a"])


def needed_steps(ids: Column) -> Column:
    """Time steps that a label sequence needs: its length and one blank between equal neighbours."""
    n = F.size(ids)
    repeats = F.zip_with(F.slice(ids, 1, F.greatest(n - 1, F.lit(0))), F.slice(ids, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: (a == b).cast("int"))
    return n + F.aggregate(F.coalesce(repeats, F.array().cast("array<int>")), F.lit(0), lambda acc, x: acc + x)


def _add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


class Decoded(NamedTuple):
    labels: list[int]
    log_prob: float
    ranking: float
    model_log_prob: float


@dataclass(frozen=True)
class LabelModel:
    """Counts of labels after contexts: the longest context seen decides, with additive smoothing; none seen means all alike. -1 pads the start."""

    order: int
    size: int
    counts: dict[tuple[int, ...], dict[int, int]]
    alpha: float = 0.1

    def __post_init__(self) -> None:
        if self.order < 1 or self.size < 1 or self.alpha <= 0:
            raise ValueError("a model needs an order, labels and smoothing")

    def score(self, prefix: tuple[int, ...], label: int) -> float:
        if not 1 <= label <= self.size:
            raise ValueError(f"label {label} is not in the model")
        padded = (-1,) * (self.order - 1) + prefix
        for n in range(self.order - 1, -1, -1):
            after = self.counts.get(padded[len(padded) - n :])
            if after:
                return math.log((after.get(label, 0) + self.alpha) / (sum(after.values()) + self.alpha * self.size))
        return -math.log(self.size)

    def sequence(self, labels: tuple[int, ...]) -> float:
        return sum(self.score(labels[:i], x) for i, x in enumerate(labels))

    @classmethod
    def collect(cls, counts: DataFrame, order: int, size: int, alpha: float = 0.1, most: int = 1_000_000) -> LabelModel:
        """From (context array<long>, label, n). A decoder holds its model in every worker, so more than ``most`` rows are an error."""
        rows = counts.select("context", "label", "n").limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"a model of more than {most} entries is too large to hold in every worker")
        found: dict[tuple[int, ...], dict[int, int]] = {}
        for context, label, n in rows:
            found.setdefault(tuple(context), {})[label] = n
        return cls(order, size, found, alpha)


def label_counts(sequences: DataFrame, order: int) -> DataFrame:
    """(context, label, n) of all contexts of 0 to ``order`` - 1 labels in arrays ``ids``; starts are padded with -1."""
    padded = F.concat(F.array_repeat(F.lit(-1).cast("long"), order - 1), F.col("ids"))
    each = sequences.select(padded.alias("p"), F.posexplode("ids").alias("i", "label"))
    sized = each.select("label", "p", "i", F.explode(F.sequence(F.lit(0), F.lit(order - 1))).alias("len"))
    context = F.when(F.col("len") == 0, F.array().cast("array<bigint>")).otherwise(F.slice("p", F.col("i") + order - F.col("len"), F.col("len")))
    return sized.groupBy(context.alias("context"), "label").agg(F.count("*").alias("n"))


def beam_search(log_probs: np.ndarray, width: int = 10, blank: int = 0, scorer: Callable[[tuple, int], float] | None = None, weight: float = 0.0, bonus: float = 0.0) -> Decoded:
    """The best label sequence of a (steps, labels) lattice by prefix beam search.

    A prefix keeps the log probability of ending in a blank and in a label; it is ranked by their sum, plus ``weight`` times what
    ``scorer`` gives its labels, plus ``bonus`` for each. No steps decode to no labels.
    """
    values = np.asarray(log_probs, float)
    if width < 1 or not math.isfinite(weight) or weight < 0 or not math.isfinite(bonus) or (scorer is None and weight):
        raise ValueError("a beam is one wide at least, a weight is finite, not negative and needs a scorer, a bonus is finite")
    if values.size == 0 and len(values) == 0:
        return Decoded([], 0.0, 0.0, 0.0)
    if values.ndim != 2 or not 0 <= blank < values.shape[1] or not np.isfinite(values).any():
        raise ValueError("a lattice has steps of labels, the blank among them, and a finite value")
    beams: dict[tuple, tuple[float, float]] = {(): (0.0, -math.inf)}
    model: dict[tuple, float] = {(): 0.0}
    rank = lambda prefix, ends: _add(*ends) + weight * model[prefix] + bonus * len(prefix)
    for step in values:
        grown: dict[tuple, list[float]] = {}

        def put(prefix: tuple, slot: int, value: float, grown=grown) -> None:
            cell = grown.setdefault(prefix, [-math.inf, -math.inf])
            cell[slot] = _add(cell[slot], value)

        for prefix, (ends_blank, ends_label) in beams.items():
            whole = _add(ends_blank, ends_label)
            put(prefix, 0, whole + step[blank])
            for label, p in enumerate(step):
                if label == blank:
                    continue
                if prefix and prefix[-1] == label:
                    put(prefix, 1, ends_label + p)
                    start = ends_blank
                else:
                    start = whole
                longer = (*prefix, label)
                if longer not in model:
                    model[longer] = model[prefix] + (scorer(prefix, label) if scorer else 0.0)
                put(longer, 1, start + p)
        best = sorted(grown.items(), key=lambda kv: (-rank(*kv), kv[0]))[:width]
        beams = {k: (v[0], v[1]) for k, v in best}
    prefix, ends = max(beams.items(), key=lambda kv: (rank(*kv), tuple(-x for x in kv[0])))
    return Decoded(list(prefix), _add(*ends), rank(prefix, ends), model[prefix])


def beam_decode(width: int = 10, blank: int = 0, model: LabelModel | None = None, weight: float = 0.0, bonus: float = 0.0):
    """A column function from array<array<double>> of log probabilities to struct<labels, log_prob, ranking, model_log_prob>.

    With a ``model`` its score counts ``weight`` times; ``bonus`` counts for each label. A null lattice decodes to null.
    """
    kind = T.StructType([T.StructField("labels", T.ArrayType(T.LongType())), *(T.StructField(n, T.DoubleType()) for n in Decoded._fields[1:])])
    scorer = model.score if model else None

    @F.pandas_udf(kind)
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for lattices in batches:
            found = [Decoded(None, None, None, None) if x is None else beam_search(np.array([np.asarray(row, float) for row in x]), width, blank, scorer, weight, bonus) for x in lattices]
            yield pd.DataFrame(found, columns=Decoded._fields)

    return decode
