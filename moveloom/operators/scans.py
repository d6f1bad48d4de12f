"""Running sums and maxima along an order, group by group, without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import written

#: Rows for which a task is made where the session's number of shuffle partitions would leave it more.
RANGE_ROWS = 500_000


def tasks_for(rows: DataFrame) -> int | None:
    """How many tasks the rows of a written table ask for; None where the session's own number is enough."""
    wanted = -(-rows.count() // RANGE_ROWS)
    return wanted if wanted > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def scan(rows: DataFrame, by: Sequence[str], order: Sequence[Column], sums: Mapping[str, Column] | None = None, maxima: Mapping[str, Column] | None = None) -> DataFrame:
    """rows with, for each name, the sum or maximum of a column over the rows of its group up to and with its own; ties come in any order.

    Rows are sorted in ranges of (group, order), so a large group lies in as many ranges as it needs. What a range hands
    on is a row for each group that goes on in the next one: one at most, however many groups there are. Ranges are as
    many as RANGE_ROWS asks for, so tasks do not grow with the table. Nulls are passed over; sums begin at 0.
    """
    sums, maxima = dict(sums or {}), dict(maxima or {})
    names = [*sums, *maxima]
    own = {n: f"_of_{n}" for n in names}
    keys = [F.col(c) for c in by]
    placed = written(rows.select("*", *(c.alias(own[n]) for n, c in {**sums, **maxima}.items())))  # once, for the count, the sample and the sort
    tasks = tasks_for(placed)
    placed = written((placed.repartitionByRange(tasks, *keys, *order) if tasks else placed.repartitionByRange(*keys, *order)).sortWithinPartitions(*keys, *order).withColumn("_range", F.spark_partition_id()))
    total = lambda n, window=None: (F.sum if n in sums else F.max)(own[n]) if window is None else (F.sum if n in sums else F.max)(own[n]).over(window)
    parts = placed.groupBy("_range", *by).agg(*(total(n).alias(own[n]) for n in names))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("_range", *by, F.count(F.lit(1)).over(earlier).alias("_earlier"), *(total(n, earlier).alias(f"_before_{n}") for n in names)).where("_earlier > 0")
    carried = carried.select(F.col("_range").alias("_at"), *(F.col(c).alias(f"_by_{c}") for c in by), *(f"_before_{n}" for n in names))
    same = F.col("_range") == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    joined = placed.join(F.broadcast(carried), same, "left")  # a row for each range that begins within a group
    joined = joined.repartition(tasks, "_range") if tasks else joined
    here = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = []
    for n in names:
        before, local = F.col(f"_before_{n}"), total(n, here)
        both = F.coalesce(before, F.lit(0)) + F.coalesce(local, F.lit(0)) if n in sums else F.greatest(before, local)
        out.append(both.alias(n))
    return joined.select(*rows.columns, *out)


def rank_rows(rows: DataFrame, by: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """rows with their number within the group, from 1."""
    return scan(rows, by, order, {name: F.lit(1).cast("long")})
