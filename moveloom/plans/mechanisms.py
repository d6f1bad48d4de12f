"""Table functions, sketches, keys of sets, permutations, draws by weight and nested exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import parse_move, parse_reference, wrapped
from ..operators import permute, setkeys, sketches, visits
from ..operators.sampling import last_of, quarantined, refuse_quarantined
from ..sources import exports, sortedbook
from ..sources.folders import work_folder
from ..sources.tables import games, table
from .registry import GAMES, query


@query("""WITH v AS (SELECT user_id, event_id, value, row_number() OVER w AS visit, sum((value > 150)::INT) OVER w AS high, value > 150 AS is_high FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, visit, CASE WHEN high = 3 THEN 3::BIGINT ELSE 0::BIGINT END AS code FROM v WHERE high < 3 OR (high = 3 AND is_high)""")
def q144_visits(spark, sf_dir):
    """Each user's events in order until the third high value, which ends the visit."""

    class Third:
        def __init__(self):
            self.high = 0

        def __call__(self, rows):
            import numpy as np

            running = self.high + np.cumsum(rows.column("value").to_numpy(zero_copy_only=False) > 150)
            self.high = int(running[-1]) if len(running) else self.high
            return np.where(running >= 3, 3, 0)

    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    return visits.visit(events, ["user_id"], ["ts", "event_id"], Third).select("user_id", "event_id", "visit", "code")


@query(f"""WITH {GAMES} SELECT game, ply::INT AS ply, array_to_string(moves[1:ply - 1], ' ') AS line, moves[ply] AS move, CASE WHEN result IS NULL THEN NULL WHEN ply % 2 = 1 THEN result / 2.0::DOUBLE ELSE 1 - result / 2.0::DOUBLE END AS points
FROM (SELECT *, unnest(range(1, least(len(moves), 5) + 1)) AS ply FROM g)""")
def q145_generated_plies(spark, sf_dir):
    """The first five plies of each game with what came before, made by a table function."""
    rows = games(spark, sf_dir).withColumn("outcome", F.col("result") / 2.0)
    return visits.plies(rows, ["game"], "moves", "outcome", 5)


@query(f"""WITH {GAMES}, p AS (SELECT o_custkey, moves, unnest(range(1, least(len(moves), 4) + 1)) AS k FROM g JOIN orders ON o_orderkey = game)
SELECT k::INT AS k, array_to_string(moves[1:k], ' ') AS prefix, count(DISTINCT o_custkey) AS players, TRUE AS within_bound FROM p GROUP BY ALL""")
def q146_sketched_players(spark, sf_dir):
    """Distinct players under each prefix, estimated from sketches of five files and held against the exact number."""
    rows = games(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("game"), "o_custkey"), "game").select("game", "moves", "o_custkey")
    store = work_folder(spark)
    for k in range(5):
        sketches.add_file(sketches.sketched(rows.where(F.col("game") % 5 == k), "moves", "o_custkey", 4), store, str(k))
    exact = rows.select("o_custkey", "moves", F.explode(F.sequence(F.lit(1), F.least(F.size("moves"), F.lit(4)))).alias("k"))
    exact = exact.groupBy("k", F.array_join(F.slice("moves", F.lit(1), F.col("k")), " ").alias("prefix")).agg(F.count_distinct("o_custkey").alias("players"))
    both = exact.join(sketches.counted(spark, store), ["k", "prefix"])
    return both.select("k", "prefix", "players", (F.abs(F.col("estimate") - F.col("players")) <= sketches.bound(F.col("players"))).alias("within_bound"))


@query("""WITH s AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag || l_linestatus || floor(l_quantity / 10)::INT::VARCHAR)) AS items FROM lineitem GROUP BY 1)
SELECT l_orderkey, min(l_orderkey) OVER (PARTITION BY items) AS same_as FROM s QUALIFY count(*) OVER (PARTITION BY items) > 1""")
def q147_equal_sets(spark, sf_dir):
    """Orders whose kinds of lines are those of another order, whatever their sequence."""
    item = F.concat("l_returnflag", "l_linestatus", F.floor(F.col("l_quantity") / 10).cast("int").cast("string"))
    return setkeys.equal_sets(table(spark, sf_dir, "lineitem").select("l_orderkey", item.alias("item")), "l_orderkey", "item")


@query("""WITH l AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, event_type AS item FROM events),
t AS (SELECT user_id, event_id, k, sum((item = 'view')::INT) OVER w % 2 AS a, sum((item = 'click')::INT) OVER w % 2 AS b, sum((item = 'purchase')::INT) OVER w % 2 AS c, sum((item = 'signup')::INT) OVER w % 2 AS d, sum((item = 'error')::INT) OVER w % 2 AS e
  FROM l WINDOW w AS (PARTITION BY user_id ORDER BY k))
SELECT event_id, row_number() OVER (PARTITION BY user_id, a, b, c, d, e ORDER BY k) - 1 AS seen_before FROM t""")
def q148_repeated_states(spark, sf_dir):
    """How often the set of what is switched on, one item a time, was the same before: a repetition."""
    from pyspark.sql import Window

    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    states = setkeys.toggled(events, ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type"))
    return states.select("event_id", (F.row_number().over(Window.partitionBy("user_id", "state").orderBy("ts", "event_id")) - 1).cast("long").alias("seen_before"))


_DRAWN = "('0x' || substr(md5('7:' || t::VARCHAR || ':' || {}::VARCHAR), 1, 13))::BIGINT"


@query(f"""WITH RECURSIVE n AS (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS a FROM orders), s AS (SELECT n, a, ((n + a - 1) // a)::BIGINT AS b FROM n),
w(key, t, l, r) AS (SELECT o_orderkey, 0, (row_number() OVER (ORDER BY o_orderkey) - 1) // b, (row_number() OVER (ORDER BY o_orderkey) - 1) % b FROM orders, s UNION ALL
  SELECT key, CASE WHEN t = {permute.ROUNDS} THEN 0 ELSE t + 1 END, CASE WHEN t < {permute.ROUNDS} AND t % 2 = 0 THEN (l + {_DRAWN.format('r')}) % a ELSE l END, CASE WHEN t < {permute.ROUNDS} AND t % 2 = 1 THEN (r + {_DRAWN.format('l')}) % b ELSE r END
  FROM w, s WHERE t < {permute.ROUNDS} OR l * b + r >= n)
SELECT key AS o_orderkey, ((l * b + r) // 100)::BIGINT AS "window", ((l * b + r) % 100)::BIGINT AS slot FROM w, s WHERE t = {permute.ROUNDS} AND l * b + r < n""")
def q149_shuffled_windows(spark, sf_dir):
    """Rows in windows of a hundred by a permutation of their numbers."""
    return permute.shuffled(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 7, 100)


#: Weights of kinds. Their mean is 2: book (0.5 of it) is filled up by game (1.5), puzzle (0.25) by what game has left (1), and game (0.25 then) by tour (1.75).
_WEIGHTS = {"book": 1.0, "game": 3.0, "puzzle": 0.5, "tour": 3.5}


@query("""WITH slots(i, c, s, o) AS (VALUES (0, 'book', 0.5::DOUBLE, 'game'), (1, 'game', 0.25::DOUBLE, 'tour'), (2, 'puzzle', 0.25::DOUBLE, 'game'), (3, 'tour', 1.0::DOUBLE, 'tour')),
u AS (SELECT c_custkey, ('0x' || substr(md5('3:' || c_custkey), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u, ('0x' || substr(md5('3:' || c_custkey), 14, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS v FROM customer)
SELECT c_custkey, CASE WHEN v < s THEN c ELSE o END AS category FROM u JOIN slots ON i = floor(u * 4)""")
def q150_weighted_draw(spark, sf_dir):
    """A kind for each customer, drawn by weight."""
    return permute.drawn(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", _WEIGHTS, 3)


@query("""SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 5 = 1 THEN NULL ELSE o_orderpriority END AS speed, CASE WHEN o_custkey % 2 = 0 THEN 'white' ELSE 'black' END AS colour, 'player' || o_custkey AS opponent,
  (1500 + o_custkey % 100)::INT AS rating, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE (1400 + o_orderkey % 300)::INT END AS opponent_rating,
  CASE WHEN o_orderstatus = 'O' THEN 0.5::DOUBLE WHEN (o_orderstatus = 'F') = (o_custkey % 2 = 0) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS points, (o_orderkey % 4)::INT AS plies,
  CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE (1500 + o_custkey % 100 - 1400 - o_orderkey % 300)::INT END AS difference FROM orders WHERE o_orderkey % 7 <> 2""")
def q151_nested_export(spark, sf_dir):
    """Games exported as nested documents, some unfinished, with ratings as numbers, texts and objects, flattened for one player."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    quoted = lambda x: F.concat(F.lit('"'), x.cast("string"), F.lit('"'))
    other = (1400 + k % 300).cast("string")
    rating = F.when(k % 4 == 0, other).when(k % 4 == 1, quoted(other)).when(k % 4 == 2, F.concat(F.lit('{"value":'), other, F.lit(',"provisional":true}')))
    side = lambda name, rating: F.concat(F.lit('{"user":{"name":'), quoted(name), F.lit("}"), F.coalesce(F.concat(F.lit(',"rating":'), rating), F.lit("")), F.lit("}"))
    me, them = side(F.lit("Me"), (1500 + c % 100).cast("string")), side(F.concat(F.lit("player"), c), rating)
    white = c % 2 == 0
    winner = F.when(F.col("o_orderstatus") == "F", ',"winner":"white"').when(F.col("o_orderstatus") == "P", ',"winner":"black"').otherwise("")
    moves = F.array_join(F.slice(F.array(*map(F.lit, ("e4", "e5", "Nf3"))), F.lit(1), (k % 4).cast("int")), " ")
    line = F.concat(
        F.lit('{"id":'), quoted(k), F.when(k % 5 == 1, "").otherwise(F.concat(F.lit(',"speed":'), quoted(F.col("o_orderpriority")))), F.lit(',"status":'), F.when(k % 7 == 2, '"started"').otherwise('"mate"'), winner,
        F.lit(',"players":{"white":'), F.when(white, me).otherwise(them), F.lit(',"black":'), F.when(white, them).otherwise(me), F.lit('},"moves":'), quoted(moves), F.lit("}"))
    base = work_folder(spark)
    table(spark, sf_dir, "orders").select(line.alias("value")).write.text(base)
    return exports.flattened(exports.read_export(spark, base), "me")


@query("""WITH e AS (SELECT (l_partkey * 922337203685477 - 4611686018427387904 + l_partkey % 2 * 4611686018427387904)::BIGINT AS key, l_linenumber AS move, l_quantity::INT AS weight, l_orderkey AS learn FROM lineitem),
w AS (SELECT (p_partkey * 922337203685477 - 4611686018427387904 + p_partkey % 2 * 4611686018427387904)::BIGINT AS key FROM part WHERE p_size < 10)
SELECT key, move::INT AS move, count(*) AS n, sum(weight)::BIGINT AS weight, sum(learn)::BIGINT AS learn FROM e JOIN w USING (key) GROUP BY ALL""")
def q152_sorted_book(spark, sf_dir):
    """Entries written in the order of their keys and looked up for some of these, with what a join would give."""
    # keys beyond 64 bits, of parts from 10,001 on, keep their lower 64, which are as many different ones
    key = lambda c: wrapped(F.col(c).cast("decimal(20,0)") * F.lit(922337203685477) - F.lit(1 << 62) + (F.col(c) % 2).cast("decimal(1,0)") * F.lit(1 << 62)).alias("key")
    entries = table(spark, sf_dir, "lineitem").select(key("l_partkey"), F.col("l_linenumber").cast("int").alias("move"), F.col("l_quantity").cast("int").alias("weight"), F.col("l_orderkey").cast("long").alias("learn"))
    book = work_folder(spark)
    sortedbook.write_book(entries, book)
    if sortedbook.write_book(entries, book, skip_if_exists=True):
        raise AssertionError("a finished book is not written again")
    found = sortedbook.look_up(spark, book, table(spark, sf_dir, "part").where("p_size < 10").select(key("p_partkey")))
    return found.groupBy("key", "move").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"), F.sum("learn").alias("learn"))


@query("""WITH m AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P') SELECT c_custkey, count(o_orderkey) AS reasons FROM customer JOIN m ON c_custkey = o_custkey GROUP BY 1""")
def q153_quarantined(spark, sf_dir):
    """Inputs that a manifest quarantines, with how often it names them; a build that has one of them is refused."""
    manifest = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    inputs = table(spark, sf_dir, "customer").select("c_custkey")
    hits = quarantined(inputs, manifest, "c_custkey")
    try:
        refuse_quarantined(inputs, manifest, "c_custkey")
    except ValueError:
        return hits
    raise AssertionError("a build with quarantined inputs was not refused")


@query("SELECT user_id, min(event_id) AS first_seen, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def q154_last_wins(spark, sf_dir):
    """The last row of each key, in the order in which keys were first seen."""
    events = table(spark, sf_dir, "events")
    return last_of(events, ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_id"), "first_seen").select("user_id", "first_seen", "event_type", "value")


@query(r"""WITH s AS (SELECT o_orderkey, o_custkey, chr((97 + o_orderkey % 8)::INT) || (1 + o_custkey % 8) || chr((97 + o_custkey % 8)::INT) || (1 + o_orderkey % 8) AS squares, CASE o_orderkey % 5 WHEN 0 THEN 'q' WHEN 1 THEN 'x' ELSE '' END AS tail FROM orders)
SELECT o_orderkey, CASE WHEN tail <> 'x' THEN (o_orderkey % 8 + 8 * (o_custkey % 8))::INT END AS source, CASE WHEN tail <> 'x' THEN (o_custkey % 8 + 8 * (o_orderkey % 8))::INT END AS target, CASE WHEN tail = 'q' THEN 'q' END AS promotion,
  'book/c' || squares AS path, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 100 END AS ply FROM s""")
def q155_parsed_moves(spark, sf_dir):
    """Moves as squares and promotions, and references to a ply of a file; what is no move or has no ply gives nulls."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    letter = lambda x: F.char((97 + x % 8).cast("int"))
    squares = F.concat(letter(k), (1 + c % 8).cast("string"), letter(c), (1 + k % 8).cast("string"))
    tail = F.when(k % 5 == 0, "q").when(k % 5 == 1, "x").otherwise("")
    reference = F.concat(F.lit("book/c"), squares, F.when(k % 3 > 0, F.concat(F.lit("@"), (k % 100).cast("string"))).otherwise(""))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", parse_move(F.concat(squares, tail)).alias("m"), parse_reference(reference).alias("r"))
    return rows.select("o_orderkey", "m.source", "m.target", "m.promotion", "r.path", "r.ply")
