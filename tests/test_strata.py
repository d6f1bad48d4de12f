"""Draws from few and large strata, quarantine, last rows, parsed moves."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from moveloom.functions.scalars import parse_move, parse_reference
from moveloom.operators import sampling


@pytest.mark.parametrize("spread", [8.0, 0.01])
def test_lowest_is_the_exact_rank(spark, spread):
    """With hardly any spread the first guess misses and is widened."""
    rng = random.Random(4)
    rows = [(rng.choice(["a"] * 20 + ["b", None]), k) for k in range(5000)]
    limits = {"a": 1200, "b": 40, None: 10_000}
    strata = defaultdict(list)
    for g, k in rows:
        strata[g].append(k)
    want = set()
    for g, keys in strata.items():
        order = sorted(keys, key=lambda k: (hashlib.md5(f"{k}:9".encode()).hexdigest(), k))
        want |= {(g, k) for k in order[: limits[g]]}
    given = spark.createDataFrame([(g, n, len(strata[g])) for g, n in limits.items()], "g string, _n long, _of long")
    got = sampling.lowest(spark.createDataFrame(rows, "g string, k long").repartition(6), ["g"], given, "k", 9, spread)
    assert got.columns == ["g", "k"] and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_shares_of_strata_that_fall_short(spark):
    rows = spark.createDataFrame([("a", k) for k in range(50)] + [("b", 100 + k) for k in range(5)], "g string, k long")
    assert sampling.equal_shares(rows, "g", "k", 20, 1, 2).count() == 0
    got = sampling.equal_shares(rows, "g", "k", 8, 1, 2).groupBy("g").count().collect()
    assert {r.g: r["count"] for r in got} == {"a": 4, "b": 4}


def test_quarantine(spark):
    inputs = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "k long")
    manifest = spark.createDataFrame([(2, "bad"), (2, "worse"), (9, "other")], "k long, why string")
    assert [tuple(r) for r in sampling.quarantined(inputs, manifest, "k").collect()] == [(2, 2)]
    with pytest.raises(ValueError, match=r"1 quarantined inputs: \[2\]"):
        sampling.refuse_quarantined(inputs, manifest, "k")
    assert sampling.refuse_quarantined(inputs, manifest.where("k = 9"), "k").count() == 5


def test_last_rows_in_first_order(spark):
    rows = [("x", 3, "late"), ("y", 1, "first"), ("x", 2, "early"), ("y", 9, "end"), (None, 5, "null")]
    got = sampling.last_of(spark.createDataFrame(rows, "k string, at int, v string"), ["k"], [F.col("at")], F.col("at"), "seen")
    assert [tuple(r) for r in got.select("k", "seen", "v").collect()] == [("y", 1, "end"), ("x", 2, "late"), (None, 5, "null")]


def test_moves_and_references(spark):
    texts = ["a1h8", "e7e8q", "e7e8k", "E2E4", "e2e", "", None, "i1a1"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(parse_move(F.col("t")).alias("m")).select("m.*").collect()
    assert [tuple(r) for r in got] == [(0, 63, None), (52, 60, "q")] + [(None, None, None)] * 6
    texts = ["a/b@12", "a@b@7", "a@", "plain", "@3", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(parse_reference(F.col("t")).alias("r")).select("r.*").collect()
    assert [tuple(r) for r in got] == [("a/b", 12), ("a@b", 7), ("a@", None), ("plain", None), ("", 3), (None, None)]
