"""The ranks of all suffixes of one long string, by the difference cover modulo three, with no step in one task.

This is the sort of suffix_array.py as DataFrame steps: triples at positions 1 and 2 modulo 3 are sorted in ranges
and numbered; if numbers repeat, the string of numbers is ranked the same way; the other suffixes follow from their
symbol and the rank behind it, and both orders are merged by counting in sorted unions. It moves every position
several times as a row of its own, so that the README's figures keep operator 5 from sorting the whole corpus so;
there it runs within buckets of anchors (substrings.py).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, prefix_sums

#: Positions per block in which a symbol's followers are looked up.
BLOCK_POSITIONS = 1 << 16


def _with_next(symbols: DataFrame) -> DataFrame:
    """(pos, a) -> (pos, a, b, c): the symbol and the two after it, 0 beyond the end; a block also holds the first two of the next."""
    block, at = F.floor(F.col("pos") / BLOCK_POSITIONS), F.col("pos") % BLOCK_POSITIONS
    blocks = F.when((at < 2) & (F.col("pos") >= BLOCK_POSITIONS), F.array(block, block - 1)).otherwise(F.array(block))
    window = Window.partitionBy("block").orderBy("pos")
    rows = symbols.withColumn("block", F.explode(blocks))
    rows = rows.withColumn("b", F.coalesce(F.lead("a", 1).over(window), F.lit(0))).withColumn("c", F.coalesce(F.lead("a", 2).over(window), F.lit(0)))
    return rows.where(F.col("block") == block).select("pos", "a", "b", "c")


def suffix_ranks(spark: SparkSession, symbols: DataFrame, n: int, scratch: Scratch | None = None) -> DataFrame:
    """symbols (pos from 0 to n - 1, a > 0) -> (pos, rank from 1): the places of the n suffixes in lexicographic order."""
    scratch = scratch or Scratch(spark)
    if n == 0:
        return symbols.select("pos", F.lit(0).cast("long").alias("rank")).where("pos is null")
    triples = scratch.keep(_with_next(symbols.select("pos", "a")))
    sample = triples.where("pos % 3 <> 0")
    if n % 3 == 1:  # a suffix of no symbols, so that the last one at 0 modulo 3 has a sampled one behind it
        sample = sample.union(spark.range(1).select(F.lit(n).cast("long").alias("pos"), *(F.lit(0).cast("long").alias(x) for x in "abc")))
    order = [F.col(x).asc() for x in "abc"]
    names = prefix_sums(scratch, sample.select("a", "b", "c").distinct(), order, {"name": F.lit(1).cast("long")})
    named = scratch.keep(sample.join(names, ["a", "b", "c"]).select("pos", (F.col("name") + 1).alias("name")))
    kinds = named.agg(F.max("name").alias("most")).first().most
    count, ones = named.count(), named.where("pos % 3 = 1").count()
    if kinds == count:
        ranked = named.select("pos", F.col("name").alias("rank"))
    else:
        place = F.when(F.col("pos") % 3 == 1, F.floor(F.col("pos") / 3)).otherwise(ones + F.floor(F.col("pos") / 3))
        below = suffix_ranks(spark, named.select(place.alias("pos"), F.col("name").alias("a")), count, scratch)
        back = F.when(F.col("pos") < ones, 3 * F.col("pos") + 1).otherwise(3 * (F.col("pos") - ones) + 2)
        ranked = below.select(back.alias("pos"), "rank")
    ranked = scratch.keep(ranked)
    behind = lambda k: ranked.select((F.col("pos") - k).alias("pos"), F.col("rank").alias(f"r{k}"))
    # a zero has sampled suffixes one and two behind it; each sampled one has one of them at the same distance
    rows = triples.join(behind(1), "pos", "left").join(behind(2), "pos", "left").join(ranked, "pos", "left")
    rows = scratch.keep(rows.select("pos", "a", "b", F.coalesce("r1", F.lit(0)).alias("r1"), F.coalesce("r2", F.lit(0)).alias("r2"), "rank", (F.col("pos") % 3).alias("kind")))
    kind = lambda k: F.when(F.col("kind") == k, 1).otherwise(0).cast("long")
    empty = 1 if n % 3 == 1 else 0  # the suffix of no symbols is ranked but not asked for
    by_one = prefix_sums(scratch, rows.where("kind <> 2").select("pos", "a", "r1", "rank", "kind"), [F.col("a").asc(), F.col("r1").asc(), F.col("kind").asc()], {"zeros": kind(0), "ones": kind(1)})
    by_two = prefix_sums(scratch, rows.where("kind <> 1").select("pos", "a", "b", "r2", "rank", "kind"), [F.col("a").asc(), F.col("b").asc(), F.col("r2").asc(), F.col("kind").asc()], {"zeros": kind(0), "twos": kind(2)})
    zeros = by_one.where("kind = 0").join(by_two.where("kind = 0").select("pos", "twos"), "pos").select("pos", (F.col("zeros") + F.col("ones") + F.col("twos") + 1).alias("rank"))
    others = [x.where(F.col("kind") == k).select("pos", (F.col("rank") - empty + F.col("zeros")).alias("rank")) for x, k in ((by_one, 1), (by_two, 2))]
    return zeros.union(others[0]).union(others[1])
