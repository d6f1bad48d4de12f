"""Every registered query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import glob
import numbers
import os

import duckdb
import pandas as pd
import pytest

from moveloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def cell(x):
    if hasattr(x, "__iter__") and not isinstance(x, str | bytes | dict):
        return str(list(x))
    if x is None or pd.isna(x):
        return None
    if type(x).__name__ in ("bool", "bool_"):
        return str(bool(x))
    if isinstance(x, numbers.Number):
        return str(round(float(x), 9))
    return str(x)


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted((tuple(map(cell, r)) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, con, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_no_rows_columns_or_characters_are_left_out(spark):
    small = "/root/testdata/sf0.01"
    customers = spark.read.parquet(f"{small}/customer.parquet").count()
    assert registry.QUERIES["q39_upsert"](spark, small).count() >= customers
    assert registry.QUERIES["q74_running_tally"](spark, small).select("a").distinct().count() == 25
    assert {f"b{k}" for k in range(25)} < set(registry.QUERIES["q69_crosstable"](spark, SF).columns)
    cells = registry.QUERIES["q86_text_keys"](spark, SF).selectExpr("max(length(cell)) AS n").first()
    assert cells.n == spark.read.parquet(f"{SF}/documents.parquet").selectExpr("max(length(text)) AS n").first().n


def test_curves_cross_their_centre(spark):
    """Runs, falls and crossings say little on a curve that is all on one side."""
    from moveloom.sources.tables import curves

    share = curves(spark, "/root/testdata/sf0.01").selectExpr("avg(int(score > 0)) AS s").first().s
    assert 0.3 < share < 0.7 and registry.QUERIES["q44_runs"](spark, "/root/testdata/sf0.01").count() > 100


def test_a_wrong_query_is_noticed(spark, con):
    got = registry.QUERIES["q03_prefix_tree"](spark, SF).where("k < 4").toPandas()
    assert rows(got) != rows(con.sql(registry.ORACLES["q03_prefix_tree"]).df())


def test_layout_does_not_matter(spark):
    from moveloom.operators.sequences import prefix_tree
    from moveloom.sources.tables import games
    from pyspark.sql import functions as F

    g = games(spark, SF)
    one, many = (prefix_tree(g.repartition(n), (1, 2, 3), F.col("result")).toPandas() for n in (1, 13))
    assert rows(one) == rows(many)
