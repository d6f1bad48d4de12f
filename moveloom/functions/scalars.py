"""Scalar expressions of game analytics; every one stays inside code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_div(x: Column, y) -> Column:
    """Division rounded down, also for negative numbers."""
    return F.floor(x / y).cast("long")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def from_side(score: Column, black_to_move: Column) -> Column:
    """A score seen from White, turned to the side that moves."""
    return F.when(black_to_move, -score).otherwise(score)


def bands(x: Column, edges: Sequence[float], names: Sequence[str], other: str = "none") -> Column:
    """Half-open bands [edge, next edge)."""
    out = F.lit(other)
    for low, high, name in reversed(list(zip(edges, edges[1:], names, strict=False))):
        out = F.when((x >= low) & (x < high), name).otherwise(out)
    return out


def expected_score(difference: Column, scale: float = 400.0) -> Column:
    """Base-10 logistic expectation of a rating difference."""
    return 1.0 / (1.0 + F.pow(F.lit(10.0), -difference / scale))


def sigmoid(x: Column, scale: float) -> Column:
    return 1.0 / (1.0 + F.exp(-x / scale))


def logit(p: Column, scale: float) -> Column:
    return scale * F.log(p / (1.0 - p))


def elo_of(score: Column) -> Column:
    """Rating difference of a score; null at 0 and 1, where it is not finite."""
    return F.when((score > 0) & (score < 1), -400.0 * F.log10(1.0 / score - 1.0))


def position_key(fields: Column, n: int = 4) -> Column:
    """The first n blank-separated fields."""
    return F.array_join(F.slice(F.split(fields, " "), 1, n), " ")


def sha1_bucket(key: Column, modulus: int) -> Column:
    """First byte of the SHA-1 sum, modulo."""
    return F.conv(F.substring(F.sha1(key.cast("string").cast("binary")), 1, 2), 16, 10).cast("int") % modulus


def seeded_order(key: Column, seed: int) -> Column:
    """A permutation key that any engine can recompute."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def truncated(x: Column, divisor: float) -> Column:
    """Division rounded towards zero."""
    return (F.signum(x) * F.floor(F.abs(x) / divisor)).cast("long")


def parse_time_control(text: Column) -> tuple[Column, Column]:
    """BASE+INCREMENT in seconds, as milliseconds."""
    parts = F.split(text, r"\+")
    return (parts[0].cast("double") * 1000).cast("long"), (F.coalesce(F.get(parts, F.lit(1)).cast("double"), F.lit(0.0)) * 1000).cast("long")


def tsv_cell(text: Column) -> Column:
    return F.translate(text, "\t\n\r", "   ")


def output_bucket(pieces: Column, buckets: int = 8) -> Column:
    return clamp(floor_div(pieces - 2, 4), 0, buckets - 1).cast("int")


def ending_label(sign: Column, plies: Column) -> Column:
    """900 less 10 a ply, at least 400, with the winner's sign."""
    return (F.signum(sign) * clamp(900 - 10 * plies, 400, 900)).cast("long")


def lowest_bit(bits: Column) -> Column:
    """Number of the lowest set bit of a word that has one."""
    return F.bit_count(F.bitwise_not(bits).bitwiseAND(bits - 1))


def highest_bit(bits: Column) -> Column:
    """Number of the highest set bit of a positive word."""
    return F.length(F.bin(bits)) - 1


def wrapped(x: Column) -> Column:
    """The lower 64 bits of a whole decimal, as a signed number."""
    half, whole = F.lit(str(1 << 63)).cast("decimal(20,0)"), F.lit(str(1 << 64)).cast("decimal(20,0)")
    return (F.pmod(x + half, whole) - half).cast("long")


def merged_maps(first: Column, second: Column) -> Column:
    """Keys of both maps; where both have one, the second's value."""
    return F.map_concat(F.map_filter(first, lambda k, _: ~F.map_contains_key(second, k)), second)


def parse_move(text: Column) -> Column:
    """struct(source, target, promotion) of a move in coordinates: squares from 0 (a1) to 63 (h8), promotion null if there is none; all null if it is no move."""
    good = text.rlike("^[a-h][1-8][a-h][1-8][qrbn]?$")
    square = lambda at: (F.ascii(F.substring(text, at, 1)) - 97 + 8 * (F.ascii(F.substring(text, at + 1, 1)) - 49)).cast("int")
    promotion = F.substring(text, 5, 1)
    return F.struct(F.when(good, square(1)).alias("source"), F.when(good, square(3)).alias("target"), F.when(good & (promotion != ""), promotion).alias("promotion"))


def parse_reference(text: Column) -> Column:
    """struct(path, ply) of `path@N`; without a number after the last `@`, all of it is the path and ply is null."""
    number = F.regexp_extract(text, "@([0-9]{1,18})$", 1)
    return F.struct(F.regexp_replace(text, "@[0-9]{1,18}$", "").alias("path"), F.when(number != "", number.try_cast("long")).alias("ply"))
