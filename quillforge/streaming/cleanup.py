"""Expiry and cleanup of finished jobs with timers: passes at a fixed delay, retention, two independent stages, retries with back-off.

A manager holds its finished jobs for ``retention`` seconds. Every ``delay`` seconds it makes a pass: jobs held long enough expire and
wait to be cleaned; of those that wait and are due, the first ``MOST`` by (retry time, job) are tried. A try has two stages, the artifact and the workspace;
a stage that succeeds isn't tried again, and what is left waits twice as long after each failure. ``outcome`` says whether a stage of a try succeeds.

The table form folds a manager's jobs in order of their end. The stream form has the same manager as state and event-time timers for its passes: a pass
happens when the watermark has gone by it, so it has seen every job that ended before it, however rows are dealt to batches.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillforge.operators.folds import fold
from quillforge.streaming.jobs import DOUBLINGS, FIRST_DELAY, LONGEST_DELAY

#: Tries of a pass, and the largest count of failures that is kept.
MOST, MOST_FAILURES = 8, 1_000_000
#: What happens to a job: expired, cleaned, or left for a retry (with its failures, the stages that are left and when it is due).
ACTS = "manager string, at double, job_id string, act string, failures int, artifact boolean, workspace boolean, retry_at double"
ACT = ("manager", "at", "job_id", "act", "failures", "artifact", "workspace", "retry_at")

Outcome = Callable[[str, str, int], bool]
#: A job that waits: when it is due, its failures so far, and whether its artifact and its workspace are still there.
Waiting = tuple[float, int, bool, bool]


class Manager:
    """Finished jobs by when they ended, and jobs that wait to be cleaned."""

    def __init__(self, held: dict[str, float] | None = None, waiting: dict[str, Waiting] | None = None):
        self.held, self.waiting = held or {}, waiting or {}

    def run(self, now: float, retention: float, outcome: Outcome, most: int = MOST) -> Iterator[tuple]:
        """One pass: (time, job, act, failures, artifact left, workspace left, due again)."""
        for job in sorted(j for j, ended in self.held.items() if ended <= now - retention):
            del self.held[job]
            self.waiting[job] = (now, 0, True, True)
            yield now, job, "expired", 0, True, True, now
        due = sorted((w[0], j) for j, w in self.waiting.items() if w[0] <= now)[:most]
        for _, job in due:
            _, failures, artifact, workspace = self.waiting[job]
            artifact = artifact and not outcome(job, "artifact", failures)
            workspace = workspace and not outcome(job, "workspace", failures)
            if artifact or workspace:
                failures = min(failures + 1, MOST_FAILURES)
                again = now + min(FIRST_DELAY * 2 ** min(failures - 1, DOUBLINGS), LONGEST_DELAY)
                self.waiting[job] = (again, failures, artifact, workspace)
                yield now, job, "retry", failures, artifact, workspace, again
            else:
                del self.waiting[job]
                yield now, job, "cleaned", failures, False, False, None

    def idle(self) -> bool:
        return not self.held and not self.waiting

    def next_due(self, retention: float) -> float:
        """When something expires or is due next; passes before then do nothing."""
        return min([t + retention for t in self.held.values()] + [w[0] for w in self.waiting.values()], default=math.inf)


def pass_at(time: float, delay: float) -> float:
    """The first pass at ``time`` or later: multiples of ``delay``, so that passes don't depend on when a manager began."""
    return float(math.ceil(time / delay) * delay)


def cleanup(ended: DataFrame, until: float, outcome: Outcome, retention: float = 3600, delay: float = 60) -> DataFrame:
    """All acts (``ACTS``) up to the time ``until`` for finished jobs: manager, job_id, ended_at (seconds).

    A job that ends twice counts with its first end. Null managers are one manager; null jobs and ends don't count. An empty table gives no rows.
    """

    def step(key: tuple, rows: list[tuple]) -> list[tuple]:
        manager, out, at, seen = Manager(), [], 0, set()
        now = -math.inf
        while True:
            ahead = rows[at][0] + retention if at < len(rows) else math.inf
            due = min(manager.next_due(retention), ahead)
            if due == math.inf or (now := max(pass_at(due, delay), now + delay)) > until:
                return out
            while at < len(rows) and rows[at][0] <= now:
                if rows[at][1] not in seen:
                    manager.held[rows[at][1]] = rows[at][0]
                    seen.add(rows[at][1])
                at += 1
            out += [(key[0], *act) for act in manager.run(now, retention, outcome)]

    slim = ended.where("job_id is not null and ended_at is not null").select("manager", F.col("ended_at").cast("double").alias("ended_at"), "job_id")
    return fold(slim, ["manager"], ["ended_at", "job_id"], step, ACTS)


class Cleaner(StatefulProcessor):
    """A manager as state; a timer is set for its next pass while it holds anything."""

    def __init__(self, outcome: Outcome, retention: float, delay: float):
        self.outcome, self.retention, self.delay = outcome, retention, delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "job_id string", "ended_at double")
        self.waiting = handle.getMapState("waiting", "job_id string", "retry_at double, failures int, artifact boolean, workspace boolean")
        self.next = handle.getValueState("next", "at double")

    def _timer(self, at: float) -> None:
        self.next.update((float(at),))
        self.handle.registerTimer(int(at * 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        first = math.inf
        for pdf in rows:
            for job, ended in zip(pdf["job_id"], pdf["ended_at"], strict=True):
                old = self.held.getValue((job,))[0] if self.held.containsKey((job,)) else math.inf
                if ended < old:
                    self.held.updateValue((job,), (float(ended),))
                first = min(first, float(ended))
        if first < math.inf:
            at = pass_at(first + self.retention, self.delay)
            if not self.next.exists():
                self._timer(at)
            elif at < self.next.get()[0]:
                self.handle.deleteTimer(int(self.next.get()[0] * 1000))
                self._timer(at)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        if not self.next.exists():
            return
        upto = timerValues.getCurrentWatermarkInMs() / 1000
        before = Manager({k[0]: v[0] for k, v in self.held.iterator()}, {k[0]: tuple(v) for k, v in self.waiting.iterator()})
        manager, late, out = Manager({}, dict(before.waiting)), sorted((v, k) for k, v in before.held.items()), []
        at = self.next.get()[0]
        while at <= upto:
            while late and late[0][0] <= at:
                ended, job = late.pop(0)
                manager.held[job] = ended
            out += [(key[0], *act) for act in manager.run(at, self.retention, self.outcome)]
            due = min(manager.next_due(self.retention), late[0][0] + self.retention if late else math.inf)
            if due == math.inf:
                break
            at = max(pass_at(due, self.delay), at + self.delay)
        manager.held.update({k: v for v, k in late})
        for state, old, new, row in ((self.held, before.held, manager.held, lambda v: (v,)), (self.waiting, before.waiting, manager.waiting, lambda v: v)):
            for job in old.keys() - new.keys():
                state.removeKey((job,))
            for job, value in new.items():
                if old.get(job) != value:
                    state.updateValue((job,), row(value))
        if manager.idle():
            self.next.clear()
        else:
            self._timer(at)
        if out:
            yield pd.DataFrame(out, columns=list(ACT))

    def close(self) -> None:
        pass


def cleanup_stream(ended: DataFrame, outcome: Outcome, retention: float = 3600, delay: float = 60, late: str = "0 seconds") -> DataFrame:
    """``cleanup`` over a stream of finished jobs: manager, job_id, ended (timestamp); append mode, RocksDB state store provider.

    Rows more than ``late`` behind the newest are dropped. A pass is made once the watermark has gone by it; passes that no timer has reached yet are made
    by the first timer after them, at their own times.
    """
    rows = ended.where("job_id is not null and ended is not null").select("manager", "job_id", "ended", (F.unix_micros("ended") / 1e6).alias("ended_at"))
    return rows.withWatermark("ended", late).groupBy("manager").transformWithStateInPandas(Cleaner(outcome, retention, delay), ACTS, "append", "EventTime")


def figures(acts: DataFrame) -> DataFrame:
    """What a manager reports about its cleanup after ``acts``: expired jobs, jobs and artifacts that still wait, tries and failed tries.

    The last act of a job says what is left of it; in one pass a job expires before it is tried.
    """
    last = F.max_by(F.struct("act", "artifact"), F.struct("at", F.col("act") != "expired"))
    tried, failed = F.count_if(F.col("act") != "expired"), F.count_if(F.col("act") == "retry")
    jobs = acts.groupBy("manager", "job_id").agg(last.alias("last"), tried.alias("tried"), failed.alias("failed"))
    waits = F.col("last.act") != "cleaned"
    return jobs.groupBy("manager").agg(
        F.count("*").alias("expired"), F.count_if(waits).alias("pending_jobs"), F.count_if(waits & F.col("last.artifact")).alias("pending_artifacts"), F.sum("tried").alias("attempts"), F.sum("failed").alias("failures")
    )
