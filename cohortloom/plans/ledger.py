"""A ledger of what each step kept and dropped, counted only when it is read."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import counted

#: Seconds that an observation may take to arrive after its job has ended.
PATIENCE = 10
SCHEMA = "step string, detail string, rows_before long, rows_after long, rows_dropped long, pct_dropped double, cols_before int, cols_after int"


@dataclass(frozen=True)
class Entry:
    step: str
    detail: str
    before: DataFrame | None = None
    after: DataFrame | None = None
    #: Makes ``after`` of ``before``, without running a job; None where that can't be said.
    make: Callable[[DataFrame], DataFrame] | None = None


@dataclass(frozen=True)
class Ledger:
    """Entries hold plans, not counts.

    Reading the ledger runs the last plan once, with a counter after each step; frames
    that don't lie on its way are counted, all in one job.
    """

    entries: tuple[Entry, ...] = ()

    def add(self, step: str, detail: str = "", before: DataFrame | None = None, after: DataFrame | None = None, make: Callable[[DataFrame], DataFrame] | None = None) -> Ledger:
        return Ledger((*self.entries, Entry(step, detail, before, after, make)))

    def rows(self) -> list[tuple]:
        frames: dict[int, DataFrame] = {id(d): d for e in self.entries for d in (e.before, e.after) if d is not None}
        counts = observed(self.entries)
        counts |= counted({k: d for k, d in frames.items() if k not in counts})
        out = []
        for e in self.entries:
            a = counts.get(id(e.before)) if e.before is not None else None
            b = counts.get(id(e.after)) if e.after is not None else None
            dropped = a - b if a is not None and b is not None else None
            pct = round(100 * dropped / a, 1) if dropped is not None and a else None
            out.append((e.step, e.detail, a, b, dropped, pct, len(e.before.columns) if e.before is not None else None, len(e.after.columns) if e.after is not None else None))
        return out

    def manifest(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), SCHEMA)


def observed(entries: tuple[Entry, ...]) -> dict[int, int]:
    """Rows of the frames (by ``id``) that lead step by step to the last one, from one run of it; none if that run's counters can't be trusted.

    Counters of a stage that is run again, as its executor was lost, count twice, and a plan that is cut short may leave one
    out: then nothing is returned, and the frames are counted plainly.
    """
    watched: dict[int, tuple[Observation, DataFrame]] = {}
    parent: dict[int, int] = {}
    tip = None
    for e in entries:
        if e.make is None or e.before is None or e.after is None or e.after is e.before:
            continue
        if id(e.before) not in watched:
            watched[id(e.before)] = _watch(e.before)
        watched[id(e.after)] = _watch(e.make(watched[id(e.before)][1]))
        parent[id(e.after)] = id(e.before)
        tip = id(e.after)
    if tip is None:
        return {}
    line = [tip]
    while line[-1] in parent:
        line.append(parent[line[-1]])
    plan = watched[tip][1]
    group = f"ledger-{uuid.uuid4().hex}"
    sc = plan.sparkSession.sparkContext
    kept = {k: sc.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")}
    sc.setJobGroup(group, "counts of a ledger")
    try:
        total = plan.agg(F.count(F.lit(1))).first()[0]
    finally:
        for k, v in kept.items():
            sc.setLocalProperty(k, v)
    if not ran_once(sc, group):
        return {}
    out = {f: _settled(watched[f][0]) for f in line}
    return out if None not in out.values() and out[tip] == total else {}


def _watch(df: DataFrame) -> tuple[Observation, DataFrame]:
    seen = Observation()
    return seen, df.observe(seen, F.count(F.lit(1)).alias("n"))


def _settled(seen: Observation) -> int | None:
    """What was counted; None if the plan that ran has no such counter, for which one would wait for ever."""
    found: list[int] = []

    def wait() -> None:
        try:
            found.append(seen.get["n"])
        except Exception:  # a counter that was optimized away has no value to read
            pass

    t = threading.Thread(target=wait, daemon=True)
    t.start()
    t.join(PATIENCE)
    return found[0] if found else None


def ran_once(sc, group: str) -> bool:
    """Whether each task of a group's jobs ended well at the first attempt."""
    tracker = sc.statusTracker()
    for job in tracker.getJobIdsForGroup(group):
        info = tracker.getJobInfo(job)
        for stage in info.stageIds if info else ():
            s = tracker.getStageInfo(stage)
            if s and (s.currentAttemptId or s.numFailedTasks or s.numCompletedTasks > s.numTasks):
                return False
    return True
