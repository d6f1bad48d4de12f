"""The states of a queue's jobs, kept by a stream of events: attempts, budgets, limits of time.

A job is pending, running, done, failed or refused; the last three are final. `start` runs a pending job, unless its budget
is spent, which refuses it. `done` ends a running job. `fail` counts an attempt and makes it pending again, or failed after
the last attempt. A job that has neither within its limit, the least of `timeout` and what is left of its budget, is stopped
there: that counts an attempt as well, and fails the job if nothing is left of the budget. Events that do not fit the state
are passed over. Times are milliseconds of event time.

Per job the stream keeps a value (state, attempts, time spent, start), a list (what went wrong, until the job is final) and
one timer. Limits are kept in event time: an event behind a limit finds the job stopped, whether the timer has fired or not,
so states do not depend on how events fall into batches. A final job keeps its few numbers and no timer.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..session import carried

TRANSITIONS = "job long, number int, at long, state string, attempts int, spent long, history string"
FINAL = ("done", "failed", "refused")
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Rules(NamedTuple):
    attempts: int
    timeout: int
    budget: int


class Job(NamedTuple):
    state: str = "pending"
    attempts: int = 0
    spent: int = 0
    started: int = 0
    number: int = 0

    def limit(self, rules: Rules) -> int:
        """When a running job is stopped."""
        return self.started + min(rules.timeout, rules.budget - self.spent)


def stopped(job: Job, rules: Rules, at: int) -> tuple[Job, str | None]:
    """The job at a time, stopped if its limit lies before."""
    if job.state != "running" or job.limit(rules) >= at:
        return job, None
    spent, attempts = job.spent + job.limit(rules) - job.started, job.attempts + 1
    over = attempts >= rules.attempts or spent >= rules.budget
    return Job("failed" if over else "pending", attempts, spent, job.started, job.number + 1), f"stopped at {job.limit(rules)}"


def step(job: Job, rules: Rules, what: str, at: int) -> tuple[Job, str | None]:
    """The job after an event, and what went wrong."""
    if what == "start" and job.state == "pending":
        return job._replace(state="refused" if job.spent >= rules.budget else "running", started=at, number=job.number + 1), "budget spent" if job.spent >= rules.budget else None
    if what == "done" and job.state == "running":
        return job._replace(state="done", spent=job.spent + at - job.started, number=job.number + 1), None
    if what == "fail" and job.state == "running":
        attempts = job.attempts + 1
        return Job("failed" if attempts >= rules.attempts else "pending", attempts, job.spent + at - job.started, job.started, job.number + 1), f"failed at {at}"
    return job, None


class Machine(StatefulProcessor):
    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle) -> None:
        self.handle = handle
        self.value = handle.getValueState("job", "state string, attempts int, spent long, started long, number int")
        self.history = handle.getListState("history", "what string")

    def _job(self) -> Job:
        held = self.value.get()
        return Job(*held) if held is not None else Job()

    def _moved(self, before: Job, after: Job, at: int, wrong: str | None, key: Any, out: list) -> Job:
        if after.number != before.number:
            if wrong:
                self.history.appendValue((wrong,))
            notes = [x[0] for x in self.history.get()] if after.state in FINAL and self.history.exists() else []
            out.append(_ROW(int(key[0]), after.number, at, after.state, after.attempts, after.spent, "; ".join(notes) or None))
        return after

    def _keep(self, before: Job, job: Job, timers: list[int]) -> None:
        """Write what changed; each call is a message to the JVM."""
        if job != before:
            self.value.update(tuple(job))
        wanted = [job.limit(self.rules) + 1] if job.state == "running" else []
        for timer in timers:
            if timer not in wanted:
                self.handle.deleteTimer(timer)
        for timer in wanted:
            if timer not in timers:
                self.handle.registerTimer(timer)
        if job.state in FINAL and before.state not in FINAL:
            self.history.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        job = before = self._job()
        if before.state in FINAL:
            return iter(())
        out: list = []
        for at, _, what in sorted((r.at, r.number, r.what) for r in rows):
            if job.state in FINAL:
                break
            limit = job.limit(self.rules)
            after, wrong = stopped(job, self.rules, at)
            job = self._moved(job, after, limit, wrong, key, out)
            after, wrong = step(job, self.rules, what, at)
            job = self._moved(job, after, at, wrong, key, out)
        # a running job has the one timer behind its limit
        self._keep(before, job, [before.limit(self.rules) + 1] if before.state == "running" else [])
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        before, out = self._job(), []
        limit = before.limit(self.rules)
        after, wrong = stopped(before, self.rules, int(expiredTimerInfo.getExpiryTimeInMs()))
        self._keep(before, self._moved(before, after, limit, wrong, key, out), list(self.handle.listTimers()))
        return iter(out)

    def close(self) -> None:
        pass


_ROW = Row(*(c.split(" ")[0] for c in TRANSITIONS.split(", ")))


def transitions(events: DataFrame, rules: Rules, delay: str = "1 minute") -> DataFrame:
    """A stream (job, number, what, ts) -> every change of a job's state; events later than the delay are passed over."""
    placed = events.withWatermark("ts", delay).select("job", "number", "what", F.unix_millis("ts").alias("at"), "ts")
    return placed.groupBy("job").transformWithState(Machine(rules), TRANSITIONS, "Append", "EventTime")


def run(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Append the transitions of all that has landed. The states of a queue of many jobs lie in files, not in memory."""
    spark, key = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    try:
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)


def states(transitions: DataFrame) -> DataFrame:
    """The state of each job that has ever left its first one."""
    last = F.max_by(F.struct("state", "attempts", "spent", "history"), "number").alias("last")
    return transitions.groupBy("job").agg(last).select("job", "last.*")


carried(__name__)
