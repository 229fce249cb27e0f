"""Sliding-window quotas: one admission rule, run over a table or a stream."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillforge.operators.folds import fold


class Quota:
    """Units admitted in the last ``window`` seconds; refused requests use nothing up, a request is admitted whole or not.

    A limit of 0 admits everything.
    """

    def __init__(self, limit: int, window: float, admitted: list[float] | None = None):
        if limit < 0 or window < 1:
            raise ValueError("a quota needs a limit of 0 or more and a window of a second or more")
        self.limit, self.window, self.units = limit, window, deque(admitted or [])

    def forget(self, now: float) -> None:
        while self.units and self.units[0] <= now - self.window:
            self.units.popleft()

    def ask(self, now: float, cost: int = 1) -> tuple[bool, int, int]:
        """(admitted, units left, seconds to wait): a refusal leaves 0 and waits for the oldest unit (at least 1), or for a whole window if none is held."""
        if cost < 1:
            raise ValueError("a request costs one unit or more")
        if not self.limit:
            return True, 0, 0
        self.forget(now)
        if len(self.units) + cost <= self.limit:
            self.units.extend([now] * cost)
            return True, self.limit - len(self.units), 0
        return False, 0, max(1, math.ceil(self.units[0] + self.window - now)) if self.units else int(self.window)


class Keyed:
    """Quotas of at most ``most`` keys: a new key beyond them is refused for a whole window, unless dropping idle ones makes room."""

    def __init__(self, limit: int, window: float, most: int = 10_000):
        if most < 1:
            raise ValueError("one key at least")
        self.limit, self.window, self.most, self.keys = limit, window, most, {}

    def ask(self, key: str, now: float, cost: int = 1) -> tuple[bool, int, int]:
        if self.limit and key not in self.keys and len(self.keys) >= self.most:
            for quota in self.keys.values():
                quota.forget(now)
            self.keys = {k: q for k, q in self.keys.items() if q.units}
            if len(self.keys) >= self.most:
                if cost < 1:
                    raise ValueError("a request costs one unit or more")
                return False, 0, int(self.window)
        if not self.limit:
            return Quota(0, self.window).ask(now, cost)
        if cost < 1:
            raise ValueError("a request costs one unit or more")
        return self.keys.setdefault(key, Quota(self.limit, self.window)).ask(now, cost)

    def snapshot(self) -> dict:
        return {"enabled": self.limit > 0, "requests": self.limit, "window_seconds": self.window, "max_clients": self.most, "tracked_clients": len(self.keys)}


ANSWERS = "key string, ord long, ts double, admitted boolean, remaining int, retry_after int"


def admit(requests: DataFrame, limit: int, window: float) -> DataFrame:
    """Decide every request (key, ord, ts in seconds, cost) of a table, each key on its own in order of ts and ord.

    A task holds the requests of its keys in turn; the state of a key is at most ``limit`` times.
    """

    def step(key: tuple, rows: list[tuple]) -> list[tuple]:
        quota = Quota(limit, window)
        return [(key[0], o, t, *quota.ask(t, c)) for o, t, c in rows]

    return fold(requests.select("key", "ord", "ts", "cost"), ["key"], ["ts", "ord"], step, ANSWERS)


def admit_bounded(requests: DataFrame, limit: int, window: float, most_keys: int, scope: str) -> DataFrame:
    """``admit`` where each value of the column ``scope`` (a server, say) tracks at most ``most_keys`` keys at a time.

    Who finds room depends on all keys of a scope in order, so a scope is one ordered stream through one task; its
    state is at most ``most_keys`` times ``limit`` times, its rows pass in batches.
    """

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now_in, quotas = object(), Keyed(limit, window, most_keys)
        for pdf in batches:
            out = []
            for s, k, o, t, c in zip(pdf[scope], pdf["key"], pdf["ord"], pdf["ts"], pdf["cost"], strict=True):
                if s != now_in:
                    now_in, quotas = s, Keyed(limit, window, most_keys)
                out.append((s, k, o, t, *quotas.ask(k, t, c)))
            yield pd.DataFrame(out, columns=[scope, "key", "ord", "ts", "admitted", "remaining", "retry_after"])

    rows = requests.select(scope, "key", "ord", "ts", "cost").repartition(scope).sortWithinPartitions(scope, "ts", "ord")
    return rows.mapInPandas(decide, f"{scope} {dict(requests.dtypes)[scope]}, {ANSWERS}")


def tracked(answers: DataFrame, now: float, window: float, limit: int, most_keys: int) -> DataFrame:
    """One row: what a limiter that gave ``answers`` tracks at ``now`` (keys with units in the window) and how it is set."""
    held = answers.where(F.col("admitted") & (F.col("ts") > now - window) & (F.col("ts") <= now))
    return held.agg(F.countDistinct("key").alias("tracked_clients")).select(F.lit(limit > 0).alias("enabled"), F.lit(limit).alias("requests"), F.lit(window).alias("window_seconds"), F.lit(most_keys).alias("max_clients"), "tracked_clients")


class QuotaProcessor(StatefulProcessor):
    """The same rule with the admitted times of a key as its state."""

    def __init__(self, limit: int, window: float):
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getListState("times", "ts double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        quota = Quota(self.limit, self.window, [t[0] for t in self.times.get()] if self.times.exists() else [])
        for pdf in rows:
            pdf = pdf.sort_values(["ts", "ord"], kind="stable")
            out = [(k, o, t, *quota.ask(t, c)) for k, o, t, c in zip(pdf["key"], pdf["ord"], pdf["ts"], pdf["cost"], strict=True)]
            yield pd.DataFrame(out, columns=["key", "ord", "ts", "admitted", "remaining", "retry_after"])
        self.times.put([(t,) for t in quota.units]) if quota.units else self.times.clear()

    def close(self) -> None:
        pass


def admit_stream(requests: DataFrame, limit: int, window: float) -> DataFrame:
    """``admit`` over a stream (append mode; needs the RocksDB state store provider)."""
    rows = requests.select("key", "ord", "ts", "cost").groupBy("key")
    return rows.transformWithStateInPandas(QuotaProcessor(limit, window), ANSWERS, "append", "None")
