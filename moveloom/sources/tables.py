"""The analogue tables: orders as games, their lines as moves, events as curves (see SURVEY 7.2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sequences import assemble

LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def result_white(status):
    """2 White won, 1 draw, 0 Black won; null stays null."""
    return F.when(status == "F", 2).when(status == "P", 0).when(status.isNotNull(), 1)


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """game, opening, result, moves."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_ORDER, "l_returnflag", "l_linestatus")
    moves = assemble(lines, "l_orderkey", LINE_ORDER, F.concat("l_returnflag", "l_linestatus"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return orders.join(moves, orders.o_orderkey == moves.l_orderkey).select(
        F.col("o_orderkey").alias("game"), F.col("o_orderpriority").alias("opening"), result_white(F.col("o_orderstatus")).alias("result"), "moves")


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """game (a user), ply, kind, score (centred on 35, near the median of the values), ts."""
    from ..operators.curves import numbered

    rows = numbered(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"])
    return rows.select(F.col("user_id").alias("game"), "ply", F.col("event_type").alias("kind"), (F.col("value") - 35.0).alias("score"), "ts", "event_id")


def pairings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, a (supplier's nation), b (customer's nation), score of a, opening."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("a"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("b"))
    score = F.when(F.col("l_returnflag") == "A", 1.0).when(F.col("l_returnflag") == "N", 0.5).otherwise(0.0)
    joined = line.join(orders, line.l_orderkey == orders.o_orderkey).join(supplier, line.l_suppkey == supplier.s_suppkey).join(customer, orders.o_custkey == customer.c_custkey)
    return joined.where("a <> b").select("a", "b", score.alias("score"), F.col("o_orderpriority").alias("opening"), "l_orderkey", "l_linenumber", "l_partkey")
