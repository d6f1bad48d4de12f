"""Operators on move sequences: assembling, prefix trees, longest-prefix classification, backed-up values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEPARATOR = " "


def assemble(rows: DataFrame, key: str, order: Sequence[str], token: Column, name: str = "moves") -> DataFrame:
    """One array of tokens per key, in a total order; combined map-side as structs, sorted once per key."""
    packed = F.struct(*order, token.alias("_token"))
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(packed)), lambda x: x["_token"]).alias(name))


def prefixes(games: DataFrame, lengths: Sequence[int], moves: str = "moves") -> DataFrame:
    """A row per game and prefix length k; games shorter than k have none. Narrow: only k and the text are added."""
    ks = F.explode(F.array(*map(F.lit, lengths)))
    single = games.withColumn("k", ks).where(F.size(moves) >= F.col("k"))
    return single.withColumn("prefix", F.array_join(F.slice(moves, F.lit(1), F.col("k")), SEPARATOR)).drop(moves)


def prefix_tree(games: DataFrame, lengths: Sequence[int], result: Column) -> DataFrame:
    """(k, prefix, white, draw, black, n): one aggregation with partial sums, no row is shuffled per prefix of a game."""
    counts = [F.sum(F.when(result == v, 1).otherwise(0)).cast("long").alias(name) for v, name in ((2, "white"), (1, "draw"), (0, "black"))]
    return prefixes(games, lengths).groupBy("k", "prefix").agg(*counts, F.count(F.lit(1)).alias("n"))


def parent_of(prefix: Column) -> Column:
    """The prefix without its last token; '' for a single one."""
    return F.when(F.instr(prefix, SEPARATOR) > 0, F.substring_index(prefix, SEPARATOR, -1)).otherwise(prefix)


def with_parent(tree: DataFrame) -> DataFrame:
    parts = F.split("prefix", SEPARATOR)
    return tree.withColumn("parent", F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), SEPARATOR))


def longest_prefix(games: DataFrame, lines: DataFrame, lengths: Sequence[int], key: str = "game") -> DataFrame:
    """Each game's deepest dictionary line (id), -1 if none; lines (id, k, prefix), of equal lines the last id wins.

    The lookup is an equi-join on (k, prefix). The dictionary is aggregated first; whether it is small enough
    to be broadcast is left to the optimiser, which knows its size.
    """
    known = lines.groupBy("k", "prefix").agg(F.max("id").alias("id"))
    hits = prefixes(games, lengths).join(known, ["k", "prefix"])
    best = hits.groupBy(key).agg(F.max(F.struct("k", "id")).alias("best"))
    return games.select(key).join(best, key, "left").select(key, F.coalesce(F.col("best.id"), F.lit(-1)).cast("long").alias("line"), F.coalesce(F.col("best.k"), F.lit(0)).cast("int").alias("depth"))


def shares(tree: DataFrame) -> DataFrame:
    """Each child's share of its parent."""
    children, parents = with_parent(tree), tree.select((F.col("k") + 1).alias("k"), F.col("prefix").alias("parent"), F.col("n").alias("parent_n"))
    return children.join(parents, ["k", "parent"]).withColumn("share", F.col("n") / F.col("parent_n"))


def backed_up(tree: DataFrame, depth: int) -> DataFrame:
    """Minimax values from the leaves up: White chooses at even plies, Black at odd ones; one join per ply."""
    level = with_parent(tree).withColumn("own", (F.col("white") + 0.5 * F.col("draw")) / F.col("n"))
    below = level.where(F.col("k") == depth).select("k", "prefix", "parent", F.col("own").alias("value"))
    out = below.select("k", "prefix", "value")
    for k in range(depth - 1, 0, -1):
        choose = F.max if k % 2 == 0 else F.min
        best = below.groupBy("parent").agg(choose("value").alias("child"))
        here = level.where(F.col("k") == k).join(best.withColumnRenamed("parent", "prefix"), "prefix", "left")
        below = here.select("k", "prefix", "parent", F.coalesce("child", "own").alias("value"))
        out = out.union(below.select("k", "prefix", "value"))
    return out


def occurrence(rows: DataFrame, group: str, key: str, order: Sequence[str]) -> DataFrame:
    """Ordinal of each occurrence of a key within its group."""
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(group, key).orderBy(*order)).cast("long"))


def in_first_order(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """Distinct keys in the order in which they first occur, as (key, first)."""
    return rows.groupBy(key).agg(F.min(order).alias("first")).orderBy("first")


def ranked_games(rows: DataFrame, by: str, game: str) -> DataFrame:
    """Groups by how many different games are in them, most first, ties by name."""
    counted = rows.groupBy(by).agg(F.count_distinct(game).alias("games"))
    return counted.withColumn("place", F.row_number().over(Window.orderBy(F.desc("games"), by)))  # a row per group


