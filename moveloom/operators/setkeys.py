"""Keys of sets that do not depend on the order of their items: the XOR of 64 bits drawn from each item."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import written


def item_bits(*item: Column, seed: int = 0) -> Column:
    """64 bits of an item, so that a set's key changes by them whether the item comes or goes."""
    return F.xxhash64(F.lit(seed), *item)


def set_keys(rows: DataFrame, by: str, item: str) -> DataFrame:
    """(by, key, other, n): two independent keys of each group's distinct items and their number, summed before the shuffle."""
    once = rows.select(by, item).distinct()
    return once.groupBy(by).agg(F.bit_xor(item_bits(F.col(item))).alias("key"), F.bit_xor(item_bits(F.col(item), seed=1)).alias("other"), F.count(F.lit(1)).alias("n"))


def equal_sets(rows: DataFrame, by: str, item: str) -> DataFrame:
    """(by, same_as): groups whose items are those of another group, with the smallest group of that class.

    Keys find the candidates; each is then compared with the smallest group of its key, item by item. Those that keys
    confuse are told apart by their sorted items.
    """
    once = written(rows.select(by, item).distinct())
    keys = written(set_keys(once, by, item))
    first = keys.groupBy("key", "other", "n").agg(F.min(by).alias("first"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    candidates = written(keys.join(first.drop("groups"), ["key", "other", "n"]).select(by, "first", "n"))
    model = once.select(F.col(by).alias("first"), F.col(item).alias("_item"))
    held = once.join(candidates, by).join(model, (F.col(item) == F.col("_item")) & candidates["first"].eqNullSafe(model["first"])).groupBy(by).agg(F.count(F.lit(1)).alias("equal"))
    judged = candidates.join(held, by, "left").withColumn("sure", F.col("n") == F.coalesce("equal", F.lit(0)))
    judged = written(judged)
    unsure = judged.where("not sure").select(by)
    listed = once.join(unsure, by, "left_semi").groupBy(by).agg(F.sort_array(F.collect_list(item)).alias("items"))
    apart = listed.groupBy("items").agg(F.min(by).alias("same_as"), F.collect_list(by).alias("_all")).where(F.size("_all") > 1).select(F.explode("_all").alias(by), "same_as")
    return judged.where("sure").select(by, F.col("first").alias("same_as")).union(apart)


def toggled(rows: DataFrame, by: Sequence[str], order: Sequence[Column], *item: Column, name: str = "state") -> DataFrame:
    """rows with the key of the set that results when each row adds its item, or takes it away if it is there."""
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.bit_xor(item_bits(*item)).over(window))
