"""Features of score curves: falls, turning points, crossings, runs, clocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, by: str, order: Sequence[str], name: str = "ply") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long"))


def falls(curve: DataFrame, by: str, ply: str, score: str, steps: int = 1) -> DataFrame:
    """What is lost until `steps` plies later."""
    return curve.withColumn("fall", F.col(score) - F.lead(score, steps).over(Window.partitionBy(by).orderBy(ply)))


def turning_point(curve: DataFrame, by: str, ply: str, score: str, level: float) -> DataFrame:
    """First ply from which every score to the end is at most level; null if none."""
    rest = Window.partitionBy(by).orderBy(ply).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return curve.withColumn("_most", F.max(score).over(rest)).groupBy(by).agg(F.min(F.when(F.col("_most") <= level, F.col(ply))).alias("turn"))


def first_at_least(curve: DataFrame, by: str, ply: str, score: str, level: float) -> DataFrame:
    return curve.groupBy(by).agg(F.min(F.when(F.col(score) >= level, F.col(ply))).alias("crossing"))


def runs(curve: DataFrame, by: str, ply: str, flag: Column) -> DataFrame:
    """Maximal runs of consecutive plies with the flag: start, end, length."""
    order = Window.partitionBy(by).orderBy(ply)
    marked = curve.withColumn("_on", flag).withColumn("_island", F.sum(F.when(flag, 0).otherwise(1)).over(order))
    return marked.where("_on").groupBy(by, "_island").agg(F.min(ply).alias("start"), F.max(ply).alias("end"), F.count(F.lit(1)).alias("length")).drop("_island")


def running_max(curve: DataFrame, by: str, ply: str, score: str, floor: float) -> DataFrame:
    upto = Window.partitionBy(by).orderBy(ply).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return curve.withColumn("running", F.greatest(F.max(score).over(upto), F.lit(floor)))


def worst(curve: DataFrame, by: str, ply: str, value: str, name: str = "worst") -> DataFrame:
    """The first maximum of a group."""
    best = curve.where(F.col(value).isNotNull()).groupBy(by).agg(F.max(F.struct(F.col(value).alias("value"), (-F.col(ply)).alias("p"))).alias("b"))
    return best.select(by, (-F.col("b.p")).alias(f"{name}_ply"), F.col("b.value").alias(f"{name}_value"))


def think_time(moves: DataFrame, by: str, side: str, order: Sequence[str], clock: str, increment: float) -> DataFrame:
    """Time a side spent: its clock before, plus the increment, less its clock now."""
    return moves.withColumn("spent", F.lag(clock).over(Window.partitionBy(by, side).orderBy(*order)) + increment - F.col(clock))


def improving(curve: DataFrame, by: str, ply: str, score: str) -> DataFrame:
    """Whether the score exceeds that of two plies before, or of four where two is missing."""
    order = Window.partitionBy(by).orderBy(ply)
    return curve.withColumn("improving", F.col(score) > F.coalesce(F.lag(score, 2).over(order), F.lag(score, 4).over(order)))
