"""The queue's state machine against a plain fold, at every stop and after restarts."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest

from moveloom.streaming import queue

BEGIN = datetime(2024, 1, 1, tzinfo=timezone.utc)
RULES = queue.Rules(3, 50_000, 120_000)


def states_by_hand(events, until):
    """Each job's events in order of time, then the time until which limits have passed."""
    jobs = {}
    for job, number, what, at in [*sorted(events, key=lambda e: (e[3], e[1])), *((j, 0, "end", until) for j in {e[0] for e in events})]:
        state, attempts, spent, started, notes = jobs.get(job, ("pending", 0, 0, 0, []))
        if state == "running" and (limit := started + min(50_000, 120_000 - spent)) < at:
            attempts, spent, notes = attempts + 1, spent + limit - started, [*notes, f"stopped at {limit}"]
            state = "failed" if attempts == 3 or spent >= 120_000 else "pending"
        if what == "start" and state == "pending":
            state, started = ("refused", at) if spent >= 120_000 else ("running", at)
            notes = [*notes, "budget spent"] if state == "refused" else notes
        elif what == "done" and state == "running":
            state, spent = "done", spent + at - started
        elif what == "fail" and state == "running":
            attempts, spent, notes = attempts + 1, spent + at - started, [*notes, f"failed at {at}"]
            state = "failed" if attempts == 3 else "pending"
        jobs[job] = (state, attempts, spent, started, notes)
    return {j: (s, a, t, "; ".join(n) or None if s in queue.FINAL else None) for j, (s, a, t, b, n) in jobs.items() if (s, b) != ("pending", 0)}


def test_states_at_every_stop(spark, tmp_path):
    rng, events, at = random.Random(3), [], int(BEGIN.timestamp() * 1000)
    for number in range(400):
        at += rng.randint(1, 9000)
        events.append((rng.randrange(25), number, rng.choice(["start", "start", "start", "done", "fail", "look"]), at))
    for stop, part in enumerate((events[:130], events[130:300], events[300:])):
        rows = [(j, n, w, datetime.fromtimestamp(a / 1000, timezone.utc)) for j, n, w, a in part]
        rng.shuffle(rows)
        spark.createDataFrame(rows, "job long, number long, what string, ts timestamp").coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        lines = spark.readStream.schema("job long, number long, what string, ts timestamp").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
        queue.run(queue.transitions(lines, RULES), f"{tmp_path}/out", f"{tmp_path}/state")
        seen = events[: (130, 300, 400)[stop]]
        got = {r.job: (r.state, r.attempts, r.spent, r.history) for r in queue.states(spark.read.schema(queue.TRANSITIONS).parquet(f"{tmp_path}/out")).collect()}
        assert got == states_by_hand(seen, seen[-1][3] - 60_000), stop
    assert {s for s, *_ in got.values()} >= {"done", "failed"}


@pytest.mark.parametrize("what, at, after", [("done", 10, "done"), ("fail", 10, "pending"), ("start", 10, "running"), ("look", 10, "running")])
def test_steps(what, at, after):
    assert queue.step(queue.Job("running", 0, 0, 5, 1), RULES, what, at)[0].state == after


def test_budgets():
    spent = queue.Job("pending", 1, 120_000, 5, 4)
    assert queue.step(spent, RULES, "start", 9) == (queue.Job("refused", 1, 120_000, 9, 5), "budget spent")
    assert queue.stopped(queue.Job("running", 0, 100_000, 0, 1), RULES, 20_001)[0].state == "failed"
    assert queue.stopped(queue.Job("running", 0, 100_000, 0, 1), RULES, 20_000)[1] is None
    assert queue.step(queue.Job("done"), RULES, "start", 9)[0].state == "done"


@pytest.mark.parametrize("name", ["q128_stream_stops", "q143_queue_states"])
def test_parts_land_in_many_files_and_one_batch_each(spark, monkeypatch, tmp_path, name):
    """No part of a log passes through one task, and states are read and written once for each part."""
    import os

    from moveloom.plans import growing, live, registry

    module = live if name.startswith("q128") else growing
    monkeypatch.setattr(module, "work_folder", lambda _: str(tmp_path))
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(6).write.parquet(f"{tmp_path}/sf/events.parquet")
    assert registry.QUERIES[name](spark, f"{tmp_path}/sf").count() >= 0
    assert len([f for f in os.listdir(f"{tmp_path}/in") if f.startswith("part-")]) >= 8
    assert len([f for f in os.listdir(f"{tmp_path}/state/commits") if f.isdigit()]) <= 4
