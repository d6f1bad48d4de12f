"""Distinct counts from sketches that are kept per file and merged up a prefix tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Registers are 2**LOG of them; an estimate is off by 1.04 / 2**(LOG / 2) of the count, as a standard deviation.
LOG = 12


def bound(count: Column, deviations: float = 4.0, log: int = LOG) -> Column:
    """How far an estimate may lie from a count: four standard deviations, and one for small counts."""
    return F.lit(1.0) + count * F.lit(deviations * 1.04 / 2 ** (log / 2))


def sketched(games: DataFrame, moves: str, value: str, most: int, log: int = LOG) -> DataFrame:
    """(line, sketch) of the values under each line of the first `most` moves; what a file adds to the store."""
    line = F.slice(moves, 1, F.least(F.size(moves), F.lit(most)))
    return games.where(F.size(moves) > 0).groupBy(line.alias("line")).agg(F.hll_sketch_agg(value, F.lit(log)).alias("sketch"))


def add_file(sketches: DataFrame, store: str, name: str) -> None:
    """Keep a file's sketches; the same name again replaces them."""
    sketches.write.mode("overwrite").parquet(f"{store}/file={name}")


def counted(spark: SparkSession, store: str) -> DataFrame:
    """(k, prefix, estimate): sketches of all files, united along the tree; no game is read."""
    kept = spark.read.parquet(store).select("line", "sketch")
    nodes = kept.select(F.explode(F.sequence(F.lit(1), F.size("line"))).alias("k"), "line", "sketch")
    nodes = nodes.groupBy("k", F.array_join(F.slice("line", F.lit(1), F.col("k")), " ").alias("prefix"))
    return nodes.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
