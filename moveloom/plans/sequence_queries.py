"""Prefix trees, opening reports and longest-prefix classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sequences as S
from ..operators.scans import rank_rows
from ..sources.folders import written
from ..sources.tables import games, result_white, table
from .registry import GAMES, TREE, query

LENGTHS = (1, 2, 3, 4)


def tree(spark, sf_dir, lengths=LENGTHS):
    return S.prefix_tree(games(spark, sf_dir), lengths, F.col("result"))


@query("""SELECT o_orderpriority AS opening, w AS white, d AS draw, b AS black, n, round(100.0 * (b + 0.5 * d) / n, 4) AS black_pct, round((w + b)::DOUBLE / n, 6) AS decisive
FROM (SELECT o_orderpriority, (count(*) FILTER (o_orderstatus = 'F'))::BIGINT AS w, (count(*) FILTER (o_orderstatus NOT IN ('F', 'P')))::BIGINT AS d, (count(*) FILTER (o_orderstatus = 'P'))::BIGINT AS b, count(*) AS n FROM orders GROUP BY 1)
WHERE n >= 10 ORDER BY black_pct DESC, opening LIMIT 5""")
def q01_opening_rank(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("opening"), result_white(F.col("o_orderstatus")).alias("r"))
    is_ = lambda v: F.sum(F.when(F.col("r") == v, 1).otherwise(0)).cast("long")
    out = rows.groupBy("opening").agg(is_(2).alias("white"), is_(1).alias("draw"), is_(0).alias("black"), F.count(F.lit(1)).alias("n")).where("n >= 10")
    return out.withColumn("black_pct", F.round(100.0 * (F.col("black") + 0.5 * F.col("draw")) / F.col("n"), 4)).withColumn("decisive", F.round((F.col("white") + F.col("black")) / F.col("n"), 6)).orderBy(F.desc("black_pct"), "opening").limit(5)


@query(f"WITH {GAMES} SELECT game, opening, result, len(moves)::INT AS plies, array_to_string(moves, ' ') AS line FROM g")
def q02_games(spark, sf_dir):
    return games(spark, sf_dir).select("game", "opening", "result", F.size("moves").alias("plies"), F.array_join("moves", " ").alias("line"))


@query(f"WITH {TREE} SELECT * FROM t")
def q03_prefix_tree(spark, sf_dir):
    return tree(spark, sf_dir)


@query(f"""WITH {GAMES} SELECT k, count(DISTINCT array_to_string(moves[1:k], ' ')) AS openings, (SELECT count(*) FROM g) AS games,
(SELECT count(*) - count(DISTINCT array_to_string(moves, ' ')) FROM g) AS duplicates FROM g, (SELECT unnest([2, 4, 8]) AS k) GROUP BY k""")
def q04_distinct_openings(spark, sf_dir):
    g = games(spark, sf_dir).withColumn("line", F.array_join("moves", " "))
    at = lambda k: F.count_distinct(F.array_join(F.slice("moves", 1, k), " "))
    one = g.agg(F.count(F.lit(1)).alias("games"), F.count_distinct("line").alias("lines"), *(at(k).alias(f"k{k}") for k in (2, 4, 8)))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("openings")) for k in (2, 4, 8))))
    return one.select(rows.alias("r"), "games", (F.col("games") - F.col("lines")).alias("duplicates")).select("r.k", "r.openings", "games", "duplicates")


@query(f"WITH {GAMES} SELECT least(len(moves) // 2 * 2, 8)::BIGINT AS plies, count(*) AS n FROM g GROUP BY 1")
def q05_plies_histogram(spark, sf_dir):
    return games(spark, sf_dir).groupBy(F.least(F.floor(F.size("moves") / 2) * 2, F.lit(8)).alias("plies")).agg(F.count(F.lit(1)).alias("n"))


def dictionary(spark, sf_dir):
    """Lines of the tree with enough games, numbered by text; a broadcastable dimension in practice."""
    lines = tree(spark, sf_dir).where("n >= 5").select("k", "prefix")
    return rank_rows(lines, [], [F.col("prefix"), F.col("k")], "id")


@query(f"""WITH {TREE}, d AS (SELECT k, prefix, row_number() OVER (ORDER BY prefix, k) AS id FROM t WHERE n >= 5)
SELECT g.game, coalesce(arg_max(d.id, d.k), -1)::BIGINT AS line, coalesce(max(d.k), 0)::INT AS depth
FROM g LEFT JOIN d ON len(g.moves) >= d.k AND array_to_string(g.moves[1:d.k], ' ') = d.prefix GROUP BY g.game""")
def q06_longest_prefix_match(spark, sf_dir):
    return S.longest_prefix(games(spark, sf_dir), dictionary(spark, sf_dir), LENGTHS)


@query(f"WITH {TREE}, q AS (SELECT *, array_to_string(string_split(prefix, ' ')[1:k - 1], ' ') AS parent FROM t) SELECT c.k, c.prefix, c.parent, c.n, p.n AS parent_n FROM q c JOIN t p ON p.k = c.k - 1 AND p.prefix = c.parent")
def q07_prefix_parent_child(spark, sf_dir):
    return S.shares(written(tree(spark, sf_dir))).select("k", "prefix", "parent", "n", "parent_n")


@query(f"""WITH {TREE}, q AS (SELECT *, array_to_string(string_split(prefix, ' ')[1:k - 1], ' ') AS parent FROM t)
SELECT c.k, c.prefix, c.n, round(c.n::DOUBLE / p.n, 6) AS share FROM q c JOIN t p ON p.k = c.k - 1 AND p.prefix = c.parent WHERE c.n >= 5 AND c.n::DOUBLE / p.n >= 0.05""")
def q08_share_followed(spark, sf_dir):
    return S.shares(written(tree(spark, sf_dir))).where((F.col("n") >= 5) & (F.col("share") >= 0.05)).select("k", "prefix", "n", F.round("share", 6).alias("share"))


@query(f"""WITH {TREE}, q AS (SELECT k, prefix, array_to_string(string_split(prefix, ' ')[1:k - 1], ' ') AS parent, (white + 0.5 * draw) / n AS own FROM t),
v4 AS (SELECT k, prefix, parent, own AS value FROM q WHERE k = 4),
v3 AS (SELECT q.k, q.prefix, q.parent, coalesce(m.v, q.own) AS value FROM q LEFT JOIN (SELECT parent, min(value) AS v FROM v4 GROUP BY parent) m ON m.parent = q.prefix WHERE q.k = 3),
v2 AS (SELECT q.k, q.prefix, q.parent, coalesce(m.v, q.own) AS value FROM q LEFT JOIN (SELECT parent, max(value) AS v FROM v3 GROUP BY parent) m ON m.parent = q.prefix WHERE q.k = 2),
v1 AS (SELECT q.k, q.prefix, q.parent, coalesce(m.v, q.own) AS value FROM q LEFT JOIN (SELECT parent, min(value) AS v FROM v2 GROUP BY parent) m ON m.parent = q.prefix WHERE q.k = 1)
SELECT k, prefix, round(value, 6) AS value FROM (SELECT * FROM v1 UNION ALL SELECT * FROM v2 UNION ALL SELECT * FROM v3 UNION ALL SELECT * FROM v4)""")
def q09_minimax_value(spark, sf_dir):
    return S.backed_up(written(tree(spark, sf_dir)), 4).select("k", "prefix", F.round("value", 6).alias("value"))


@query(f"WITH {GAMES} SELECT game, len(moves)::INT AS plies FROM g WHERE len(moves) >= 4 AND moves[1:2] = ['NO', 'NO'] AND opening IN ('1-URGENT', '2-HIGH')")
def q10_line_filters(spark, sf_dir):
    """Length, list-prefix and set-membership filters."""
    g = games(spark, sf_dir).where(F.col("opening").isin("1-URGENT", "2-HIGH"))
    return g.where((F.size("moves") >= 4) & (F.slice("moves", 1, 2) == F.array(F.lit("NO"), F.lit("NO")))).select("game", F.size("moves").alias("plies"))


@query(f"WITH {GAMES}, r AS (SELECT game, unnest(moves) AS move, generate_subscripts(moves, 1) AS ply FROM g) SELECT game, move, ply, row_number() OVER (PARTITION BY game, move ORDER BY ply) AS occurrence, row_number() OVER (PARTITION BY game, move ORDER BY ply) = 3 AS threefold FROM r")
def q11_occurrence(spark, sf_dir):
    """Ordinal of each repetition, and where the third one falls."""
    rows = games(spark, sf_dir).select("game", F.posexplode("moves").alias("at", "move")).select("game", "move", (F.col("at") + 1).cast("long").alias("ply"))
    return S.occurrence(rows, "game", "move", ["ply"]).withColumn("threefold", F.col("occurrence") == 3)


@query(f"WITH {GAMES}, r AS (SELECT game, unnest(moves) AS move, generate_subscripts(moves, 1) AS ply FROM g), d AS (SELECT move, (row_number() OVER (ORDER BY move))::BIGINT AS system FROM (SELECT DISTINCT move FROM r) WHERE move LIKE '%F') SELECT game, arg_max(system, ply) AS system, max(ply)::BIGINT AS ply FROM r JOIN d USING (move) GROUP BY game")
def q12_last_system(spark, sf_dir):
    """The deepest ply that is in a dictionary decides."""
    rows = games(spark, sf_dir).select("game", F.posexplode("moves").alias("at", "move"))
    known = rank_rows(rows.select("move").distinct().where(F.col("move").endswith("F")), [], [F.col("move")], "system")
    best = rows.join(known, "move").groupBy("game").agg(F.max(F.struct("at", "system")).alias("b"))
    return best.select("game", F.col("b.system").alias("system"), (F.col("b.at") + 1).cast("long").alias("ply"))


@query(f"""WITH {GAMES}, f AS (SELECT opening, game, moves, row_number() OVER (PARTITION BY opening ORDER BY game) AS rn FROM g)
SELECT a.opening, array_to_string(list_sort(list_distinct(list_filter(a.moves, lambda x: NOT list_contains(b.moves, x)))), ' ') AS extra, array_to_string(list_sort(list_distinct(list_filter(b.moves, lambda x: NOT list_contains(a.moves, x)))), ' ') AS missing
FROM f a JOIN f b ON a.opening = b.opening AND a.rn = 1 AND b.rn = 2""")
def q13_symmetric_difference(spark, sf_dir):
    """What either of two move lists has beyond the other."""
    first = games(spark, sf_dir).groupBy("opening").agg(F.min_by("moves", "game").alias("a"), F.min("game").alias("first"))
    rest = games(spark, sf_dir).join(first, "opening").where(F.col("game") > F.col("first")).groupBy("opening").agg(F.min_by("moves", "game").alias("b"), F.first("a").alias("a"))
    text = lambda x, y: F.array_join(F.array_sort(F.array_except(x, y)), " ")
    return rest.select("opening", text("a", "b").alias("extra"), text("b", "a").alias("missing"))
