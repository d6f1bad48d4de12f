"""Every registered query and the SQL that an independent engine answers it with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with its SQL where there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Common tables of the SQL side: games (g), curves (c) and pairings (p).
GAMES = """g AS (SELECT o_orderkey AS game, o_orderpriority AS opening, CASE WHEN o_orderstatus = 'F' THEN 2 WHEN o_orderstatus = 'P' THEN 0 WHEN o_orderstatus IS NOT NULL THEN 1 END AS result, m.moves
  FROM orders JOIN (SELECT l_orderkey, list(l_returnflag || l_linestatus ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_returnflag || l_linestatus) AS moves FROM lineitem GROUP BY l_orderkey) m ON m.l_orderkey = o_orderkey)"""
CURVES = """c AS (SELECT user_id AS game, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ply, event_type AS kind, value - 35.0::DOUBLE AS score, ts, event_id FROM events)"""
PAIRINGS = """p AS (SELECT s_nationkey AS a, c_nationkey AS b, CASE l_returnflag WHEN 'A' THEN 1.0::DOUBLE WHEN 'N' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score, o_orderpriority AS opening, l_orderkey, l_linenumber, l_partkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey)"""
TREE = GAMES + """, t AS (SELECT k, array_to_string(moves[1:k], ' ') AS prefix, (count(*) FILTER (result = 2))::BIGINT AS white, (count(*) FILTER (result = 1))::BIGINT AS draw, (count(*) FILTER (result = 0))::BIGINT AS black, count(*) AS n
  FROM g, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(moves) >= k GROUP BY ALL)"""

from . import calibration, curve_queries, features, growing, ledgers, live, mechanisms, rating_queries, sampling_queries, sequence_queries, source_queries  # noqa: E402, F401
