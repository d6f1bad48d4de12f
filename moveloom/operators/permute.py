"""Orders that need no sort: a keyed permutation of row numbers, windows over it, and draws of a category by weight."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import rank_rows

ROUNDS = 6
#: Row numbers from here on are outside the permuted square by more rows than fit in a task's memory as a table.
MOST_ROWS = 1 << 46


def sides(n: int) -> tuple[int, int]:
    """a * b, little more than n: the square that rounds work on."""
    a = math.isqrt(n - 1) + 1 if n > 1 else 1
    return a, -(-n // a)


def _drawn(seed: int, turn: int, value: int, modulus: int) -> int:
    return int(hashlib.md5(f"{seed}:{turn}:{value}".encode()).hexdigest()[:13], 16) % modulus


def permuted_number(x: int, n: int, seed: int) -> int:
    """The rounds in plain numbers: two digits of x, each shifted in turn by what is drawn from the other; again while outside."""
    a, b = sides(n)
    while True:
        left, right = divmod(x, b)
        for turn in range(ROUNDS):
            if turn % 2 == 0:
                left = (left + _drawn(seed, turn, right, a)) % a
            else:
                right = (right + _drawn(seed, turn, left, b)) % b
        x = left * b + right
        if x < n:
            return x


def _once(x: Column, n: int, seed: int) -> Column:
    a, b = sides(n)
    pair = F.struct(F.floor(x / b).cast("long").alias("l"), (x % b).cast("long").alias("r"))

    def turned(pair: Column, turn: Column) -> Column:
        even = turn % 2 == 0
        other = F.when(even, pair["r"]).otherwise(pair["l"])
        bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), turn.cast("string"), other.cast("string"))), 1, 13), 16, 10).cast("long")
        return F.struct(F.when(even, (pair["l"] + bits) % a).otherwise(pair["l"]).alias("l"), F.when(even, pair["r"]).otherwise((pair["r"] + bits) % b).alias("r"))

    done = F.aggregate(F.array(*(F.lit(t) for t in range(ROUNDS))), pair, turned)
    return done["l"] * b + done["r"]


def permuted(rows: DataFrame, number: str, n: int, seed: int, name: str = "place") -> DataFrame:
    """rows with the place of their number (0 to n - 1) in a permutation that seed and n determine.

    Narrow: no row moves. The square has fewer than isqrt(n) + 1 places beyond n; where each of them leads in the end is
    a table of so many rows, walked here and broadcast.
    """
    if n > MOST_ROWS:
        raise ValueError(f"a permutation of more than {MOST_ROWS} rows")
    a, b = sides(n)
    first = rows.withColumn(name, _once(F.col(number), n, seed))
    outside = [(x, permuted_number(x, n, seed)) for x in range(n, a * b)]
    if not outside:
        return first
    led = rows.sparkSession.createDataFrame(outside, "_from long, _to long")
    joined = first.join(F.broadcast(led), F.col(name) == F.col("_from"), "left")  # isqrt(n) rows at most
    return joined.withColumn(name, F.coalesce("_to", name)).drop("_from", "_to")


def shuffled(rows: DataFrame, key: str, seed: int, window: int) -> DataFrame:
    """rows with window and slot: a shuffle into windows of equal size, as a loader reads them; keys must be unique."""
    numbered = rank_rows(rows, [], [F.col(key)], "_number").withColumn("_number", F.col("_number") - 1)
    placed = permuted(numbered, "_number", max(1, numbered.count()), seed)
    return placed.select(*rows.columns, F.floor(F.col("place") / window).cast("long").alias("window"), (F.col("place") % window).alias("slot"))


def alias_table(weights: Mapping[str, float]) -> list[tuple[str, float, str]]:
    """(category, share, other): one slot per category, which keeps a draw with probability share and hands it on otherwise.

    Categories in the order of their names; those below the mean are filled up from those above it. Weights are finite,
    not negative and not all zero.
    """
    if not weights or any(not math.isfinite(w) or w < 0 for w in weights.values()) or not sum(weights.values()):
        raise ValueError("weights are numbers from 0 on, one of them greater")
    mean = sum(weights.values()) / len(weights)
    left = {c: w / mean for c, w in sorted(weights.items())}
    small, large = [c for c in left if left[c] < 1], [c for c in left if left[c] >= 1]
    slots = {}
    while small and large:
        poor, rich = small.pop(0), large[0]
        slots[poor] = (left[poor], rich)
        left[rich] -= 1 - left[poor]
        if left[rich] < 1:
            small.append(large.pop(0))
    slots |= {c: (1.0, c) for c in (*small, *large)}
    return [(c, *slots[c]) for c in left]


def drawn(rows: DataFrame, key: str, weights: Mapping[str, float], seed: int, name: str = "category", most: int = 10_000) -> DataFrame:
    """rows with a category drawn by weight from a hash of the key: one lookup a row, the same on every run.

    There are at most `most` categories, which become a literal of the plan.
    """
    if len(weights) > most:
        raise ValueError(f"more than {most} categories")
    slots = alias_table(weights)
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    number = lambda at: F.conv(F.substring(digest, at, 13), 16, 10).cast("double") / float(1 << 52)
    table = F.array(*(F.struct(F.lit(c).alias("c"), F.lit(float(s)).alias("s"), F.lit(o).alias("o")) for c, s, o in slots))
    slot = F.get(table, F.floor(number(1) * len(slots)).cast("int"))
    return rows.withColumn(name, F.when(number(14) < slot["s"], slot["c"]).otherwise(slot["o"]))
