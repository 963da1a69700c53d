"""Progress while work runs: rows, rate and time left, of streams by their events and of batch jobs by what tasks report."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from contextlib import suppress
from dataclasses import dataclass, field
from typing import TypeVar

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

_T = TypeVar("_T")


@dataclass(frozen=True)
class Step:
    """Rows read so far after ``seconds``; ``share`` of the work and seconds ``left`` where its size is known."""

    label: str
    rows: int
    seconds: float
    share: float | None = None

    @property
    def rate(self) -> float:
        return self.rows / self.seconds if self.seconds else 0.0

    @property
    def left(self) -> float | None:
        return None if not self.share else self.seconds * (1 - self.share) / self.share

    def line(self) -> str:
        part = "" if self.share is None else f"{100 * self.share:.1f} %, "
        wait = "" if self.left is None else f", {self.left / 60:.1f} min left"
        return f"{self.label}: {part}{self.rows:,} rows, {self.rate:,.0f} a second{wait}"


@dataclass
class StreamProgress(StreamingQueryListener):
    """Collects a step for each batch of every query; ``total`` rows, if known, give shares. ``spark.streams.addListener`` puts it to work."""

    total: int | None = None
    tell: Callable[[Step], None] | None = None
    steps: dict[str, list[Step]] = field(default_factory=dict)
    ended: dict[str, str | None] = field(default_factory=dict)
    _began: dict[str, float] = field(default_factory=dict)

    def onQueryStarted(self, event) -> None:
        self._began[str(event.runId)] = time.monotonic()

    def onQueryProgress(self, event) -> None:
        p = event.progress
        run = str(p.runId)
        own = self.steps.setdefault(run, [])
        rows = (own[-1].rows if own else 0) + int(p.numInputRows)
        share = None if not self.total else min(1.0, rows / self.total)
        own.append(Step(p.name or run, rows, time.monotonic() - self._began.get(run, time.monotonic()), share))
        if self.tell:
            self.tell(own[-1])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.runId)] = event.exception


def _stages(spark: SparkSession, group: str) -> tuple[int, float]:
    """Input rows that the stages of a job group have reported, and the share of their tasks that are done."""
    tracker, store = spark.sparkContext.statusTracker(), spark._jsc.sc().statusStore()
    rows = done = tasks = 0
    for job in tracker.getJobIdsForGroup(group):
        info = tracker.getJobInfo(job)
        for stage in info.stageIds if info else ():
            with suppress(Exception):  # a stage that hasn't begun has no entry
                data = store.lastStageAttempt(stage)
                if data.status().toString() == "SKIPPED":  # its output was there already
                    continue
                rows, done, tasks = rows + data.inputRecords(), done + data.numCompleteTasks(), tasks + data.numTasks()
    return rows, done / tasks if tasks else 0.0


def watch(spark: SparkSession, label: str, action: Callable[[], _T], tell: Callable[[Step], None], every: float = 30.0) -> _T:
    """``action()``, whose Spark jobs' progress is told every so many seconds while it runs, and once at its end.

    Rows are those that stages have read from files, as tasks report them (with their heartbeats
    and when they end), so a table that is read twice counts twice; the share is of the tasks
    known so far and can fall when a later job begins.
    """
    group, began, over = f"{label}-{time.monotonic_ns()}", time.monotonic(), threading.Event()

    def report() -> None:
        rows, share = _stages(spark, group)
        tell(Step(label, rows, time.monotonic() - began, share))

    def poll() -> None:
        while not over.wait(every):
            with suppress(Exception):  # progress never ends the work
                report()

    context, poller = spark.sparkContext, threading.Thread(target=poll, daemon=True)
    before = [context.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description")]
    context.setJobGroup(group, label)
    poller.start()
    try:
        return action()
    finally:
        over.set()
        poller.join()
        report()
        for key, value in zip(("spark.jobGroup.id", "spark.job.description"), before, strict=True):
            context.setLocalProperty(key, value)
