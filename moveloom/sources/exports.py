"""Nested exports of games, a JSON document a line, whose fields come and go and change their type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: States in which a game is not over.
UNFINISHED = ("created", "started")


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """(doc variant) per line; a line that is no JSON document gives null."""
    return spark.read.text(path).select(F.try_parse_json("value").alias("doc"))


def field(path: str, kind: str) -> Column:
    """A field of the document as a type; null where it is missing, null or cannot be read as that type."""
    return F.try_variant_get("doc", path, kind)


def flattened(docs: DataFrame, me: str) -> DataFrame:
    """A row per finished game of a player: id, speed, colour, opponent, ratings, their difference, points, moves.

    Names are compared without case. A rating may be a number, a number in quotes or missing; with `provisional` it may be
    an object that has it as `value`. Without a winner a finished game is drawn. Games that the player is not in, and
    documents that are no objects, are left out.
    """
    rating = lambda side: F.coalesce(field(f"$.players.{side}.rating", "int"), field(f"$.players.{side}.rating.value", "int"))
    name = lambda side: field(f"$.players.{side}.user.name", "string")
    wide = docs.select(
        field("$.id", "string").alias("id"), field("$.speed", "string").alias("speed"), field("$.status", "string").alias("status"), field("$.winner", "string").alias("winner"), field("$.moves", "string").alias("moves"),
        *(f(side).alias(f"{side}_{what}") for side in ("white", "black") for what, f in (("name", name), ("rating", rating))))
    mine = lambda side: F.lower(f"{side}_name") == me.lower()
    colour = F.when(mine("white"), "white").when(mine("black"), "black")
    ended = wide.where(F.col("status").isNotNull() & ~F.col("status").isin(*UNFINISHED)).withColumn("colour", colour).where("colour is not null")
    of = lambda what, own: F.when((F.col("colour") == "white") == F.lit(own), F.col(f"white_{what}")).otherwise(F.col(f"black_{what}"))
    points = F.when(F.col("winner").isNull(), 0.5).when(F.col("winner") == F.col("colour"), 1.0).otherwise(0.0)
    moves = F.when(F.coalesce(F.trim("moves"), F.lit("")) == "", 0).otherwise(F.size(F.split(F.trim("moves"), r"\s+")))
    out = ended.select("id", "speed", "colour", of("name", False).alias("opponent"), of("rating", True).alias("rating"), of("rating", False).alias("opponent_rating"), points.alias("points"), moves.alias("plies"))
    return out.withColumn("difference", F.col("rating") - F.col("opponent_rating"))
