"""Schedules of jobs with lanes and requirements, against a plain counterpart; running sums in ranges."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from moveloom.operators import jobs, scans

SCHEMA = "id long, lane string, place long, state string, started double, hours double, requires array<string>, makes string"


def schedule_by_hand(rows, now):
    """Recursion over what each job waits for; None where that leads back to itself."""
    by_id, makers, lanes, known = {r[0]: r for r in rows}, defaultdict(list), defaultdict(list), {}
    for r in rows:
        if r[7] is not None and r[3] in ("running", "pending"):
            makers[r[7]].append(r[0])
        if r[3] == "pending":
            lanes[r[1]].append((r[2], r[0]))
    free = defaultdict(lambda: now)
    for i, lane, _, state, started, hours, _, _ in rows:
        if state == "running":
            start = now if started is None else started
            finish = None if hours is None else start + hours if start + hours >= now else now + 1 / 6
            known[i] = (start, finish)
            if finish is not None:
                free[lane] = max(free[lane], finish)
    order = {lane: [i for _, i in sorted(v)] for lane, v in lanes.items()}

    def held(i, path):
        """When the lane is free behind job i, for which one without an estimate does not count."""
        if by_id[i][5] is None:
            lane = order[by_id[i][1]]
            at = lane.index(i)
            return held(lane[at - 1], path) if at else free[by_id[i][1]]
        times = settle(i, path)
        return times and times[1]

    def settle(i, path=()):
        if i in known:
            return known[i]
        if i in path:
            return None
        lane = order[by_id[i][1]]
        at = lane.index(i)
        start = free[by_id[i][1]] if not at else held(lane[at - 1], (*path, i))
        for need in by_id[i][6] or []:
            for maker in makers[need]:
                if by_id[maker][5] is None:
                    continue
                times = settle(maker, (*path, i))
                if times is None or start is None:
                    start = None
                elif times[1] is not None:
                    start = max(start, times[1])
        times = None if start is None else (start, None if by_id[i][5] is None else start + by_id[i][5])
        if times is not None or not path:
            known[i] = times
        return times

    out = {}
    for r in rows:
        if r[3] in ("running", "pending"):
            times = settle(r[0])
            out[r[0]] = (*(times or (None, None)), times is None)
    return out


def some_jobs(n, seed, backwards):
    rng, rows = random.Random(seed), []
    for i in range(n):
        state = "pending" if i > 3 else "running" if i < 3 else "done"
        needs = [f"f{rng.randrange(n if backwards and rng.random() < 0.1 else max(1, i))}" for _ in range(rng.choice((0, 0, 0, 1, 2)))]
        rows.append((i, rng.choice(["cpu", "gpu", "net"]), i, state, rng.choice((None, 3.0, 9.5)) if state == "running" else None, rng.choice((None, 0.5, 1.0, 2.5, 4.0)), needs or None, f"f{i // 2}" if backwards and i % 9 == 8 else f"f{i}" if i % 4 else None))
    return rows


@pytest.mark.parametrize("seed, backwards", [(1, False), (2, True)])
def test_schedule(spark, seed, backwards):
    rows = some_jobs(40, seed, backwards)
    got = {r.id: (r.start, r.finish, r.in_cycle) for r in jobs.scheduled(spark.createDataFrame(rows, SCHEMA), 10.0).collect()}
    want = schedule_by_hand(rows, 10.0)
    assert set(got) == set(want)
    for i, (start, finish, cycle) in want.items():
        assert got[i] == (pytest.approx(start) if start is not None else None, pytest.approx(finish) if finish is not None else None, cycle), (i, rows[i])
    assert any(c for _, _, c in got.values()) == backwards


def test_requirements_that_hold_nothing_up_take_no_rounds(spark, monkeypatch):
    """Two lanes that name each other's jobs all along, though these are long done: few scans, the same times."""
    rows = [(i, "ab"[i % 2], i, "pending", None, 1.0, [f"f{i - 3}"] if i > 5 else None, f"f{i}") for i in range(60)]
    scanned, scan = [], jobs.scan
    monkeypatch.setattr(jobs, "scan", lambda *args, **more: scanned.append(1) or scan(*args, **more))
    got = {r.id: (r.start, r.finish, r.in_cycle) for r in jobs.scheduled(spark.createDataFrame(rows, SCHEMA), 0.0).collect()}
    assert got == schedule_by_hand(rows, 0.0)
    assert len(scanned) <= 4


def test_cycles_and_odd_jobs(spark):
    rows = [(1, "a", 1, "pending", None, 1.0, ["x"], "y"), (2, "b", 1, "pending", None, 1.0, ["./y"], "x"), (3, "b", 2, "pending", None, 1.0, None, None), (4, "c", 1, "pending", None, 1.0, ["self"], "self"),
            (5, "d", 1, "pending", None, 2.0, ["later//z/"], None), (6, "e", 1, "pending", None, 3.0, ["nobody makes this"], "later/q/../z"), (7, None, 1, "done", None, 1.0, ["x"], None), (8, "e", 2, "pending", None, None, [], None)]
    got = {r.id: (r.start, r.finish, r.in_cycle) for r in jobs.scheduled(spark.createDataFrame(rows, SCHEMA), 0.0).collect()}
    lost = (None, None, True)
    assert got == {1: lost, 2: lost, 3: lost, 4: lost, 6: (0.0, 3.0, False), 5: (3.0, 5.0, False), 8: (3.0, None, False)}
    assert jobs.scheduled(spark.createDataFrame([], SCHEMA), 0.0).count() == 0


def test_scan_over_ranges(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["big", "big", "big", None, "small"]), k, rng.choice([None, 1, 2, 7])) for k in range(600)] + [(f"g{k}", 0, k) for k in range(50)]
    df = spark.createDataFrame(rows, "g string, k long, v long").repartition(7)
    got = {(r.g, r.k): (r.total, r.top) for r in scans.scan(df, ["g"], [F.col("k")], {"total": F.col("v")}, {"top": F.col("v")}).collect()}
    assert len(got) == len(rows)
    running = {}
    for g, k, v in sorted(rows, key=lambda r: r[1]):
        total, top = running.get(g, (0, None))
        running[g] = (total + (v or 0), v if top is None else top if v is None else max(top, v))
        assert got[g, k] == running[g]
    numbers = scans.rank_rows(df, ["g"], [F.col("k").desc()], "n").where("g = 'big'").orderBy("n").collect()
    assert [r.n for r in numbers] == list(range(1, len(numbers) + 1)) and [r.k for r in numbers] == sorted((r.k for r in numbers), reverse=True)


def test_tasks_of_scans_do_not_grow_with_rows(spark, monkeypatch):
    monkeypatch.setattr(scans, "RANGE_ROWS", 50)
    df = spark.range(4000).select(F.lit("one").alias("g"), F.col("id").alias("k"))
    out = scans.scan(df, ["g"], [F.col("k")], {"total": F.col("k")}).withColumn("task", F.spark_partition_id())
    assert out.where("total <> k * (k + 1) / 2").count() == 0 and out.count() == 4000
    assert max(r["count"] for r in out.groupBy("task").count().collect()) <= 400
    from moveloom.operators import ratings

    games = spark.range(4000).select(F.lit("one").alias("opening"), (F.col("id") % 2 == 0).alias("white"), F.col("id").alias("seq"), (F.col("id") / 4000).alias("points"))
    pairs = ratings.pair_up(games, "opening", "white", "seq", "points").withColumn("task", F.spark_partition_id())
    assert {r.pair: r.a_points for r in pairs.collect()} == {k + 1: 2 * k / 4000 + (2 * k + 1) / 4000 for k in range(2000)}
    assert max(r["count"] for r in pairs.groupBy("task").count().collect()) <= 200
