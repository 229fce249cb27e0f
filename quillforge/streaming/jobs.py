"""Job lifecycles as tables and streams: latest state, durations, expiry, retries, admission, request metrics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillforge.operators.folds import fold
from quillforge.operators.linked import settled

#: States a job goes through; the last three are final.
STATES = ("uploading", "queued", "running", "succeeded", "failed", "cancelled")
FINAL = STATES[3:]
#: Seconds before the first retry, doublings and the longest delay.
FIRST_DELAY, DOUBLINGS, LONGEST_DELAY = 30, 7, 3600


#: What each event does to a job: the states it may come in, and the state it leads to.
MOVES = {"enqueue": ("uploading", "queued"), "start": ("queued", "running"), "succeed": ("running", "succeeded"), "fail": ("running", "failed")}


class Job:
    """The state of one job. A cancelled job is cancelled where its next step would begin or end: at once while queued, else at that step."""

    def __init__(self, status: str | None = None, cancel: bool = False):
        self.status, self.cancel = status, cancel

    def take(self, event: str) -> bool:
        """Whether the event had an effect; final states stay whatever comes after."""
        if event == "reserve":
            fresh = self.status is None
            self.status = "uploading" if fresh else self.status
            return fresh
        if self.status is None or self.status in FINAL:
            return False
        if event == "cancel":
            fresh, self.cancel = not self.cancel, True
            if self.status == "queued":
                self.status = "cancelled"
            return fresh
        if event not in MOVES or MOVES[event][0] != self.status:
            return False
        ends_cancelled = self.cancel and event != "fail"
        self.status = "cancelled" if ends_cancelled else MOVES[event][1]
        return True


CHANGES = "job_id string, ord long, event string, status string, taken boolean"


def lifecycle(events: DataFrame) -> DataFrame:
    """The state of a job after each event (job_id, ord, event: reserve, enqueue, start, succeed, fail, cancel), and whether the event had an effect. One job is one group."""

    def step(key: tuple, rows: list[tuple]) -> list[tuple]:
        job, out = Job(), []
        for o, e in rows:
            taken = job.take(e)
            out.append((key[0], o, e, job.status, taken))
        return out

    return fold(events.select("job_id", "ord", "event"), ["job_id"], ["ord"], step, CHANGES)


class JobProcessor(StatefulProcessor):
    """``lifecycle`` with a job's status and cancel flag as its state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("job", "status string, cancel boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        job = Job(*self.state.get()) if self.state.exists() else Job()
        for pdf in rows:
            out = []
            for j, o, e in pdf.sort_values("ord", kind="stable")[["job_id", "ord", "event"]].itertuples(index=False):
                taken = job.take(e)
                out.append((j, o, e, job.status, taken))
            yield pd.DataFrame(out, columns=["job_id", "ord", "event", "status", "taken"])
        if job.status is not None:
            self.state.update((job.status, job.cancel))

    def close(self) -> None:
        pass


def lifecycle_stream(events: DataFrame) -> DataFrame:
    """``lifecycle`` over a stream (append mode; needs the RocksDB state store provider)."""
    return events.select("job_id", "ord", "event").groupBy("job_id").transformWithStateInPandas(JobProcessor(), CHANGES, "append", "None")


def latest(events: DataFrame) -> DataFrame:
    """The state of each job (job_id, ord, status): a final state stays, whatever comes after."""
    done = F.col("status").isin(*FINAL)
    first_final = F.min_by("status", F.when(done, F.col("ord")))
    rows = events.groupBy("job_id").agg(first_final.alias("final"), F.max_by("status", "ord").alias("last"), F.max(done).alias("ended"))
    return rows.select("job_id", F.when(F.col("ended"), F.col("final")).otherwise(F.col("last")).alias("status"))


def snapshot(jobs: DataFrame) -> DataFrame:
    """Jobs by status, all six statuses listed."""
    every = jobs.sparkSession.createDataFrame([(s,) for s in STATES], "status string")
    return every.join(jobs.groupBy("status").agg(F.count("*").alias("n")), "status", "left").na.fill(0)


def durations(jobs: DataFrame) -> DataFrame:
    """Count and seconds of final jobs by status; a job that never started counts from its creation, never below 0."""
    seconds = F.greatest(F.lit(0.0), F.unix_micros("completed_at") / 1e6 - F.unix_micros(F.coalesce("started_at", "created_at")) / 1e6)
    return jobs.where(F.col("status").isin(*FINAL)).groupBy("status").agg(F.count("*").alias("n"), F.sum(seconds).alias("seconds"))


def expired(jobs: DataFrame, now: Column, retention_seconds: int) -> DataFrame:
    done = F.col("status").isin(*FINAL)
    return jobs.where(done & (F.col("completed_at") <= now - F.make_dt_interval(secs=F.lit(retention_seconds))))


def retry_delay(failures: Column) -> Column:
    return F.least(F.lit(FIRST_DELAY) * F.pow(F.lit(2), F.least(failures - 1, F.lit(DOUBLINGS))), F.lit(LONGEST_DELAY))


def due(entries: DataFrame, now: Column, most: int = 8) -> DataFrame:
    """The ``most`` entries (job_id, retry_at) that are due, earliest first (a bounded pass)."""
    return entries.where(F.col("retry_at") <= now).orderBy("retry_at", "job_id").limit(most)


def running_load(changes: DataFrame, part: str) -> DataFrame:
    """Open jobs after each change (ord, change of +1 or -1) within ``part``."""
    return changes.withColumn("load", F.sum("change").over(Window.partitionBy(part).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)))


#: Downloads open at a time, of one job and of all.
JOB_DOWNLOADS, ALL_DOWNLOADS = 4, 32


class Admission:
    """What one manager holds: jobs that run and jobs that it keeps. A request is admitted whole or not."""

    def __init__(self, most_active: int, most_retained: int):
        if not 1 <= most_active <= most_retained:
            raise ValueError("a manager runs one job at least and keeps as many as it runs")
        self.most_active, self.most_retained, self.active, self.retained = most_active, most_retained, 0, 0

    def take(self, kind: str, n: int) -> str | None:
        """reserve n jobs, finish n of those that run, or drop n finished ones; why a reservation is refused, or None."""
        if kind == "finish":
            self.active = max(0, self.active - n)
        elif kind == "drop":
            self.retained = max(self.active, self.retained - n)
        elif n < 1:
            return "nothing requested"
        elif self.active + n > self.most_active:
            return "capacity"
        elif self.retained + n > self.most_retained:
            return "retained"
        else:
            self.active, self.retained = self.active + n, self.retained + n
        return None


class Leases:
    """Open downloads of one manager: of a job at most ``per_job``, of all at most ``most``. A lease is released once."""

    def __init__(self, per_job: int = JOB_DOWNLOADS, most: int = ALL_DOWNLOADS):
        self.per_job, self.most, self.open, self.of_job = per_job, most, {}, Counter()

    def take(self, kind: str, lease: str, job: str, ready: bool) -> str | None:
        if kind == "release":
            if (held := self.open.pop(lease, None)) is not None:
                self.of_job[held] -= 1
            return None
        if not ready:
            return "not ready"
        if lease in self.open or self.of_job[job] >= self.per_job or len(self.open) >= self.most:
            return "capacity"
        self.open[lease] = job
        self.of_job[job] += 1
        return None


def _in_order(events: DataFrame, manager: str, columns: list[str], start, step, result: str) -> DataFrame:
    """Fold a manager's events in order of ``ord``, in batches: one manager's decisions follow one another, managers run side by side."""
    kinds = dict(events.dtypes)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if row[0] != now:
                    now, state = row[0], start()
                out.append((*row, *step(state, *row[2:])))
            yield pd.DataFrame(out, columns=[*pdf.columns, *(c.split()[0] for c in result.split(", "))])

    names = [manager, "ord", *columns]
    rows = events.select(*names).repartition(manager).sortWithinPartitions(manager, "ord")
    return rows.mapInPandas(fold, ", ".join(f"{c} {kinds[c]}" for c in names) + ", " + result)


#: Most states of a manager (running times kept jobs) for which ranges of its events are decided apart.
STATES_MOST = 4096


def _moves(kind: str, n: int, most_active: int, most_retained: int) -> np.ndarray:
    """The state after an event for each state before it; a state is active * (most_retained + 1) + retained."""
    active, retained = np.divmod(np.arange((most_active + 1) * (most_retained + 1)), most_retained + 1)
    if kind == "finish":
        active = np.maximum(0, active - n)
    elif kind == "drop":
        retained = np.maximum(active, retained - n)
    elif n >= 1:
        fits = (active + n <= most_active) & (retained + n <= most_retained)
        active, retained = active + n * fits, retained + n * fits
    return active * (most_retained + 1) + np.minimum(most_retained, retained)


def admissions(events: DataFrame, manager: str, most_active: int, most_retained: int, parts: int | None = None) -> DataFrame:
    """Decide every reservation among events (``manager``, ord, kind: reserve, finish, drop, n), with the jobs held after each event. Events without a manager go.

    A manager's decisions follow one another, yet its events aren't one task's: they lie in ranges of (manager, ord), ``parts`` of them. Each range first tells what its
    last manager holds at its end, for every state that it may begin in; from one row a range follows where each begins, and ranges are decided side by side.
    """
    Admission(most_active, most_retained)
    events = events.where(F.col(manager).isNotNull())

    def step(state: Admission, kind: str, n: int) -> tuple:
        return state.take(kind, n), state.active, state.retained

    result, base = "refused string, active long, retained long", most_retained + 1
    taken_back = events.where("kind IN ('finish', 'drop') AND n < 0")  # would lead beyond the bounds
    if (most_active + 1) * base > STATES_MOST or not taken_back.isEmpty():
        return _in_order(events, manager, ["kind", "n"], lambda: Admission(most_active, most_retained), step, result)
    parts = parts or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = events.select(manager, "ord", "kind", "n").repartitionByRange(parts, manager, "ord").sortWithinPartitions(manager, "ord")
    rows = settled(rows.withColumn("part", F.spark_partition_id()))
    kind_of = dict(rows.dtypes)[manager]
    every = np.array([a * base + r for a in range(most_active + 1) for r in range(a, base)])

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = now = part = ends = None
        moves = lru_cache(1024)(lambda kind, n: _moves(kind, n, most_active, most_retained))
        for pdf in batches:
            part = int(pdf["part"].iloc[0])
            new = np.flatnonzero(np.r_[True, pdf[manager].to_numpy()[1:] != pdf[manager].to_numpy()[:-1]])
            name, since = pdf[manager].iloc[-1], int(new[-1])  # only what the last manager holds is of use to the next range
            if first is None:
                first, now, ends = pdf[manager].iloc[0], pdf[manager].iloc[0], every
            if name != now:
                now, ends = name, np.zeros(1, np.int64)
            for kind, n in zip(pdf["kind"].tolist()[since:], pdf["n"].tolist()[since:], strict=True):
                ends = moves(kind, n)[ends]
        if part is not None:
            yield pd.DataFrame({"part": [part], "first": [first], "last": [now], "ends": [ends.tolist()]})

    begins, held, before = {}, 0, None
    for r in sorted(rows.mapInPandas(told, f"part int, first {kind_of}, last {kind_of}, ends array<long>").collect()):
        begins[r["part"]] = held = held if r["first"] == before else 0
        held = r["ends"][int(np.searchsorted(every, held))] if r["first"] == r["last"] else r["ends"][0]
        before = r["last"]

    def decided(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, part, state = object(), None, None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False, name=None):
                if row[0] != now or row[4] != part:
                    state = Admission(most_active, most_retained)
                    if row[4] != part:
                        state.active, state.retained = divmod(begins[row[4]], base)
                    now, part = row[0], row[4]
                out.append((*row[:4], *step(state, row[2], row[3])))
            yield pd.DataFrame(out, columns=[manager, "ord", "kind", "n", "refused", "active", "retained"])

    kinds = dict(rows.dtypes)
    return rows.mapInPandas(decided, ", ".join(f"{c} {kinds[c]}" for c in (manager, "ord", "kind", "n")) + ", " + result)


def leases(events: DataFrame, manager: str, per_job: int = JOB_DOWNLOADS, most: int = ALL_DOWNLOADS) -> DataFrame:
    """Decide every download among events (``manager``, ord, kind: acquire or release, lease, job, ready), with the leases open after each event."""

    def step(state: Leases, kind: str, lease: str, job: str, ready: bool) -> tuple:
        return state.take(kind, lease, job, bool(ready)), state.of_job[job], len(state.open)

    return _in_order(events, manager, ["kind", "lease", "job", "ready"], lambda: Leases(per_job, most), step, "refused string, open_of_job long, open_of_all long")


# --- journal -----------------------------------------------------------------------------------------------------------

JOURNAL = "job_id string, artifact_key string, workspace_pending boolean, retry_at timestamp, failures int"


def journal_step(journal: DataFrame, changes: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(new journal, violations) after a batch of changes, which is taken whole or not at all: with violations the journal stays as it is.

    ``changes``: op and the columns of ``JOURNAL``, one for each job. add: the job must be new. publish: the job must have no artifact yet, a pending
    workspace and no failures, and gets one. expire: a known job must have the same artifact and a pending workspace, an unknown one is added.
    update: the job must be known; without an artifact and a pending workspace it goes.
    """
    old = journal.select("job_id", *(F.col(c).alias(f"was_{c}") for c in ("artifact_key", "workspace_pending", "retry_at", "failures")), F.lit(True).alias("known"))
    times = F.count("*").over(Window.partitionBy("job_id"))
    both = changes.withColumn("times", times).join(old, "job_id", "left")
    known = F.coalesce("known", F.lit(False))
    claim = known & F.col("was_artifact_key").isNull() & F.col("was_workspace_pending") & (F.col("was_failures") == 0)
    sound = F.col("artifact_key").isNotNull() & F.col("workspace_pending") & (F.col("failures") == 0)
    mine = F.col("artifact_key").eqNullSafe(F.col("was_artifact_key")) & F.col("was_workspace_pending")
    problem = (
        F.when(F.col("times") > 1, "several changes of one job")
        .when(~F.col("op").isin("add", "publish", "expire", "update"), "unknown change")
        .when((F.col("op") == "add") & known, "job is known")
        .when((F.col("op") == "publish") & ~sound, "not a publication")
        .when((F.col("op") == "publish") & ~claim, "workspace is not owned")
        .when((F.col("op") == "expire") & known & ~mine, "publication is not owned")
        .when((F.col("op") == "update") & ~known, "job is unknown")
    )
    judged = both.withColumn("problem", problem).withColumn("known", known)
    own = ("artifact_key", "workspace_pending", "retry_at", "failures")
    published = F.col("op") == "publish"  # takes the artifact and the time, nothing else
    kept = {c: F.when(published, F.col(f"was_{c}")).otherwise(F.col(c)) for c in ("workspace_pending", "failures")}
    gone = (F.col("op") == "update") & F.col("artifact_key").isNull() & ~F.col("workspace_pending")
    written = judged.where(~gone).withColumns(kept).select("job_id", *own)
    after = journal.select("job_id", *own).join(changes.select("job_id"), "job_id", "left_anti").unionByName(written)
    bad = judged.where("problem is not null").select("job_id", "problem")
    full = after.agg(F.count("*").alias("n")).where(F.col("n") > most).select(F.lit(None).cast("string").alias("job_id"), F.lit("journal is full").alias("problem"))
    bad = bad.unionByName(full)
    any_bad = bad.agg((F.count("*") > 0).alias("bad"))
    choice = after.withColumn("new", F.lit(True)).unionByName(journal.select("job_id", *own).withColumn("new", F.lit(False)))
    return choice.join(F.broadcast(any_bad), F.lit(True)).where(F.col("new") != F.col("bad")).drop("new", "bad"), bad  # any_bad is one row


def captures(events: DataFrame) -> DataFrame:
    """Uploads of a capture session (page, ord, kind: upload or delete, name), whether each was taken, and the file a page has after it.

    A page has one file; another upload is refused until it is deleted. With one file at a time the state is a fold that a window can
    tell: an upload is taken if it is the first since the last delete.
    """
    w = Window.partitionBy("page").orderBy("ord")
    round_ = F.count(F.when(F.col("kind") == "delete", 1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = events.withColumn("round", round_)
    first = F.row_number().over(Window.partitionBy("page", "round", "kind").orderBy("ord")) == 1
    taken = F.when(F.col("kind") == "upload", first).otherwise(F.lit(True))
    held = F.min_by("name", F.when(F.col("kind") == "upload", F.col("ord"))).over(Window.partitionBy("page", "round").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("taken", taken).withColumn("file", held).drop("round")


def request_metrics(requests: DataFrame) -> DataFrame:
    """Requests and seconds by method, route and status; works on tables and, with a watermark, on streams."""
    return requests.groupBy("method", "route", "status").agg(F.count("*").alias("n"), F.sum(F.greatest(F.lit(0.0), F.col("seconds"))).alias("seconds"))


def request_durations(metrics: DataFrame) -> DataFrame:
    """Requests and seconds by method and route, from ``request_metrics``."""
    return metrics.groupBy("method", "route").agg(F.sum("n").alias("n"), F.sum("seconds").alias("seconds"))


def prometheus(metrics: DataFrame, name: str, escape, labels: tuple[str, ...] = ("method", "route", "status"), value: str = "n") -> DataFrame:
    """One line of text exposition for each series, labels escaped, with its place in order of the labels."""
    label = lambda c: F.concat(F.lit(f'{c}="'), escape(F.col(c).cast("string")), F.lit('"'))
    line = F.concat(F.lit(name + "{"), F.concat_ws(",", *map(label, labels)), F.lit("} "), F.col(value).cast("string"))
    return metrics.select(F.row_number().over(Window.orderBy(*labels)).alias("place"), line.alias("line"))  # as many rows as series


def tumbling(events: DataFrame, minutes: int, watermark: str | None = None) -> DataFrame:
    """Events and values per window and type."""
    rows = events.withWatermark("ts", watermark) if watermark else events
    got = rows.groupBy(F.window("ts", f"{minutes} minutes"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, minutes: int) -> DataFrame:
    """Sessions of a user: events less than ``minutes`` apart."""
    got = events.groupBy(F.session_window("ts", f"{minutes} minutes"), "user_id").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return got.select("user_id", "first", "last", "n")
