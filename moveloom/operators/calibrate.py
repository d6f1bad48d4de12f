"""Calibrating one scorer's scale against another, and pooling committees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upper_median(rows: DataFrame, by: Sequence[str], value: str, key: str) -> DataFrame:
    """v[n // 2] of the sorted values."""
    w = Window.partitionBy(*by)
    placed = rows.withColumn("_at", F.row_number().over(w.orderBy(value, key))).withColumn("_n", F.count(F.lit(1)).over(w))
    return placed.where(F.col("_at") == F.floor(F.col("_n") / 2) + 1).select(*by, F.col(value).alias("median"), F.col("_n").alias("n"))


def exclusive_quartile(rows: DataFrame, by: Sequence[str], value: str, key: str, part: int) -> DataFrame:
    """Quartile by the exclusive method: position part * (n + 1) / 4, linear between neighbours."""
    w = Window.partitionBy(*by)
    order = w.orderBy(value, key)
    placed = rows.withColumn("_at", F.row_number().over(order)).withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_next", F.lead(value).over(order))
    position = F.lit(part) * (F.col("_n") + 1)
    j = F.greatest(F.lit(1), F.least(F.floor(position / 4), F.col("_n") - 1))
    delta = (position - j * 4) / 4.0
    return placed.where((F.col("_at") == j) & (F.col("_n") > 1)).select(*by, (F.col(value) * (1 - delta) + F.col("_next") * delta).alias("quartile"))


def consensus(votes: DataFrame, by: str, answer: str, voter_order: str, least_votes: int, least_answers: int) -> DataFrame:
    """The most common answer; null below the quorum; of equal counts the one of the first voter."""
    counts = votes.where(F.col(answer).isNotNull()).groupBy(by, answer).agg(F.count(F.lit(1)).alias("votes"), F.min(voter_order).alias("first"))
    top = counts.groupBy(by).agg(F.max(F.struct("votes", (-F.col("first")).alias("earlier"), F.col(answer).alias("answer"))).alias("top"), F.sum("votes").alias("answers"), F.count(F.lit(1)).alias("kinds"))
    ok = (F.col("top.votes") >= least_votes) & (F.col("answers") >= least_answers)
    return top.select(by, F.when(ok, F.col("top.answer")).alias("consensus"), F.col("top.votes").alias("votes"), "answers", "kinds")


def bin_medians(rows: DataFrame, x: str, y: str, edges: Sequence[float], least: int) -> DataFrame:
    """Median of y in bins of x that are closed on both ends, so a point on an edge counts in both; at least `least` points.

    The bins are a handful of constants, so they are attached as an exploded array, not by a join.
    """
    bins = F.array(*(F.struct(F.lit(i).alias("bin"), F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high")) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))))
    inside = rows.select(x, y, F.explode(F.filter(bins, lambda b: (F.col(x) >= b["low"]) & (F.col(x) <= b["high"]))).alias("b"))
    out = inside.groupBy(F.col("b.bin").alias("bin")).agg(F.percentile(x, 0.5).alias("x"), F.percentile(y, 0.5).alias("y"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row per bin
    return out.withColumn("scaled", F.greatest(F.max("y").over(upto), F.lit(0.0)))


def interpolate(x: Column, xs: Sequence[float], ys: Sequence[float]) -> Column:
    """Piecewise linear, flat outside, odd in x."""
    a = F.abs(x)
    out = F.lit(float(ys[-1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(zip(xs, ys), list(zip(xs, ys))[1:], strict=False))):
        out = F.when(a <= x1, y0 + (a - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return F.signum(x) * F.when(a <= xs[0], float(ys[0])).otherwise(out)


def grid_fit(rows: DataFrame, grid: Sequence[float], loss) -> DataFrame:
    """The parameter with the least mean loss, the smallest of equal ones.

    Every grid value is one more column of the same aggregation, so rows are read once and never multiplied.
    """
    sums = rows.agg(*(F.avg(loss(F.lit(float(g)))).alias(f"g{i}") for i, g in enumerate(grid)))
    best = F.array_min(F.array(*(F.struct(F.round(F.col(f"g{i}"), 9).alias("loss"), F.lit(float(g)).alias("parameter")) for i, g in enumerate(grid))))
    return sums.select(best["parameter"].alias("parameter"), best["loss"].alias("loss"))
