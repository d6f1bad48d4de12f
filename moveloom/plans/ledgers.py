"""Experience folds, lineage, budgets, log scraping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import expected_score, parse_time_control
from ..sources.tables import table
from .registry import query

_EXPERIENCE = """WITH e AS (SELECT user_id % 40 AS key, event_type AS move, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ply, CASE WHEN value >= 330 THEN 1.0::DOUBLE WHEN value >= 160 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS v, (user_id % 50) * 8.0 AS diff FROM events),
x AS (SELECT key, move, (count(*) FILTER (v = 1))::BIGINT AS wins, (count(*) FILTER (v = 0.5))::BIGINT AS draws, (count(*) FILTER (v = 0))::BIGINT AS losses, sum(v - 1.0 / (1.0 + pow(10.0, -diff / 400.0))) AS r, min(ply) AS min_ply FROM e GROUP BY ALL)"""


def experience(spark, sf_dir):
    from ..operators.curves import numbered

    e = numbered(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"])
    v = F.when(F.col("value") >= 330, 1.0).when(F.col("value") >= 160, 0.5).otherwise(0.0)
    e = e.select((F.col("user_id") % 40).alias("key"), F.col("event_type").alias("move"), "ply", v.alias("v"), ((F.col("user_id") % 50) * 8.0).alias("diff"))
    n = lambda x: F.sum((F.col("v") == x).cast("long"))
    return e.groupBy("key", "move").agg(n(1.0).alias("wins"), n(0.5).alias("draws"), n(0.0).alias("losses"), F.sum(F.col("v") - expected_score(F.col("diff"))).alias("r"), F.min("ply").alias("min_ply"))


@query(f"{_EXPERIENCE} SELECT key, move, wins, draws, losses, round(r, 5) AS residual, min_ply FROM x")
def q89_experience(spark, sf_dir):
    """Results per position and move, with the residual against expectation."""
    return experience(spark, sf_dir).select("key", "move", "wins", "draws", "losses", F.round("r", 5).alias("residual"), "min_ply")


@query(f"{_EXPERIENCE} SELECT key, move FROM x WHERE (wins + draws + losses >= 5 AND r / (wins + draws + losses) < -0.15) OR (losses >= 3 AND losses = wins + draws + losses)")
def q90_flagged_moves(spark, sf_dir):
    n = F.col("wins") + F.col("draws") + F.col("losses")
    return experience(spark, sf_dir).where(((n >= 5) & (F.col("r") / n < -0.15)) | ((F.col("losses") >= 3) & (F.col("losses") == n))).select("key", "move")


@query(f"{_EXPERIENCE}, a AS (SELECT DISTINCT key, move FROM x WHERE losses > wins), s AS (SELECT DISTINCT user_id % 40 AS key, event_type AS move FROM events WHERE value > 485) SELECT a.key, a.move FROM a LEFT JOIN s ON a.key = s.key AND a.move = s.move WHERE s.key IS NULL")
def q91_avoid_with_override(spark, sf_dir):
    """A list to avoid, less what a second source overrides."""
    a = experience(spark, sf_dir).where("losses > wins").select("key", "move")
    s = table(spark, sf_dir, "events").where("value > 485").select((F.col("user_id") % 40).alias("key"), F.col("event_type").alias("move"))
    return a.join(s, ["key", "move"], "left_anti")


@query("""WITH j AS (SELECT o_orderkey AS job, o_orderpriority AS network, unnest(list_value(o_custkey % 100, o_custkey % 77)) AS chunk, unnest(list_value(1, 2)) AS copies FROM orders WHERE o_orderstatus = 'F'),
m AS (SELECT s_suppkey AS chunk, s_acctbal AS take FROM supplier WHERE s_acctbal > 0)
SELECT network, count(DISTINCT job) AS jobs, count(DISTINCT j.chunk) AS chunks, round(sum(coalesce(m.take, 100.0) * copies), 2) AS positions FROM j LEFT JOIN m ON j.chunk = m.chunk GROUP BY network""")
def q92_catalog(spark, sf_dir):
    """Which chunks went into which network, and how many positions that makes; copies count again."""
    used = F.explode(F.array(F.struct((F.col("o_custkey") % 100).alias("chunk"), F.lit(1).alias("copies")), F.struct((F.col("o_custkey") % 77).alias("chunk"), F.lit(2).alias("copies"))))
    j = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("job"), F.col("o_orderpriority").alias("network"), used.alias("u")).select("job", "network", "u.chunk", "u.copies")
    m = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("chunk"), F.col("s_acctbal").alias("take"))
    return j.join(m, "chunk", "left").groupBy("network").agg(F.count_distinct("job").alias("jobs"), F.count_distinct("chunk").alias("chunks"), F.round(F.sum(F.coalesce("take", F.lit(100.0)) * F.col("copies")), 2).alias("positions"))


@query("""SELECT user_id % 10 AS team, event_type AS kind, count(*) AS n, round(sum(coalesce(CASE WHEN event_id % 5 <> 0 THEN epoch_us(ts) + value * 1000000 END, epoch_us(TIMESTAMP '2024-02-01')) - epoch_us(ts)) / 3600e6, 3) AS hours FROM events GROUP BY ALL""")
def q93_hours(spark, sf_dir):
    """Hours used per team and kind; what is unfinished counts up to now."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    now = F.unix_micros(F.lit("2024-02-01").cast("timestamp"))
    end = F.coalesce(F.when(F.col("event_id") % 5 != 0, micros + F.col("value") * 1000000), now.cast("double"))
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("team"), F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(end - micros) / 3600e6, 3).alias("hours"))


@query(r"""WITH l AS (SELECT o_orderkey, 'games ' || (o_custkey % 50 + 3) || ' wins ' || (o_custkey % 50) || ' draws 2 losses 1 elo +' || (o_orderkey % 90) || ' +/- ' || (o_custkey % 40) || ' tc ' || (o_custkey % 5 + 1) || '+0.1' AS line FROM orders)
SELECT o_orderkey, regexp_extract(line, 'games (\d+)', 1)::INT AS games, regexp_extract(line, 'wins (\d+) draws (\d+) losses (\d+)', 1)::INT AS wins, regexp_extract(line, 'elo ([+-]\d+)', 1)::INT AS elo, regexp_extract(line, '\+/- (\d+)', 1)::INT AS margin, (regexp_extract(line, 'tc (\S+)\+', 1)::DOUBLE * 1000)::BIGINT AS base_ms, 100::BIGINT AS increment_ms FROM l""")
def q94_log_lines(spark, sf_dir):
    """Results scraped from log lines."""
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    line = F.concat(F.lit("games "), c % 50 + 3, F.lit(" wins "), c % 50, F.lit(" draws 2 losses 1 elo +"), k % 90, F.lit(" +/- "), c % 40, F.lit(" tc "), c % 5 + 1, F.lit("+0.1"))
    at = lambda p, g=1: F.regexp_extract("line", p, g)
    base, increment = parse_time_control(at(r"tc (\S+)"))
    return table(spark, sf_dir, "orders").select("o_orderkey", line.alias("line")).select(
        "o_orderkey", at(r"games (\d+)").cast("int").alias("games"), at(r"wins (\d+) draws (\d+) losses (\d+)").cast("int").alias("wins"), at(r"elo ([+-]\d+)").cast("int").alias("elo"),
        at(r"\+/- (\d+)").cast("int").alias("margin"), base.alias("base_ms"), increment.alias("increment_ms"))


@query("SELECT event_type, count(*) AS n, sum((props::JSON ->> 'k')::BIGINT)::BIGINT AS k, max((props::JSON ->> 'k')::BIGINT) AS top FROM events GROUP BY 1")
def q95_json_props(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k"), F.max(k).alias("top"))


@query("SELECT user_id, event_type, (epoch_us(ts) // 86400000000) - 19723 AS generation FROM events WHERE (epoch_us(ts) // 86400000000) > (SELECT max(epoch_us(ts) // 86400000000) - 3 FROM events)")
def q96_last_generations(spark, sf_dir):
    """Rows of the last three generations (days)."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86400000000).alias("day"))
    last = rows.agg(F.max("day").alias("d")).first().d
    return rows.where(F.col("day") > last - 3).select("user_id", "event_type", (F.col("day") - 19723).alias("generation"))


@query("SELECT source, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source")
def q97_source_shares(spark, sf_dir):
    """Only the total is gathered; sources are never together in one task."""
    docs = table(spark, sf_dir, "documents")
    n = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
    return n.select("source", "n", F.round(F.col("n") / docs.count(), 6).alias("share"), "chars")


@query("SELECT l_returnflag AS side, count(*) AS n, (count(*) FILTER (l_linenumber = 1))::BIGINT AS first, (count(*) FILTER (l_linenumber <= 3))::BIGINT AS top3, round(sum(greatest(0, least(300, l_quantity * 10))), 2) AS loss, (count(*) FILTER (l_quantity * 10 >= 100))::BIGINT AS blunders FROM lineitem GROUP BY 1")
def q98_judge(spark, sf_dir):
    """Tallies per side: first choices, top three, clipped losses, blunders."""
    x = F.col("l_quantity") * 10
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("side")).agg(
        F.count(F.lit(1)).alias("n"), n(F.col("l_linenumber") == 1).alias("first"), n(F.col("l_linenumber") <= 3).alias("top3"), F.round(F.sum(F.greatest(F.lit(0.0), F.least(F.lit(300.0), x))), 2).alias("loss"), n(x >= 100).alias("blunders"))


@query("SELECT user_id AS job, arg_max(event_type, (ts, event_id)) AS state, count(*) FILTER (event_type = 'error') AS failures, count(*) FILTER (event_type = 'error') <= 2 AS retried FROM events GROUP BY user_id")
def q102_job_state(spark, sf_dir):
    """The state of each job is its last event; a job is tried again while it failed at most twice."""
    failures = F.sum((F.col("event_type") == "error").cast("long"))
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("job")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), failures.alias("failures"), (failures <= 2).alias("retried"))


@query("""WITH e AS (SELECT user_id % 40 AS key, event_type AS move, ts < TIMESTAMP '2024-01-16' AS older, value / 490.0 - 0.5 AS r FROM events),
f AS (SELECT key, move FROM e WHERE older GROUP BY ALL HAVING count(*) >= 5 AND avg(r) < -0.05)
SELECT f.key IS NOT NULL AS flagged, count(*) AS n, round(avg(r), 6) AS mean FROM e LEFT JOIN f ON e.key = f.key AND e.move = f.move WHERE NOT older GROUP BY 1""")
def q103_backtest(spark, sf_dir):
    """Moves flagged on the older half of the log, judged on the newer one."""
    older = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("key"), F.col("event_type").alias("move"), older.alias("older"), (F.col("value") / 490.0 - 0.5).alias("r"))
    flagged = e.where("older").groupBy("key", "move").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean")).where("n >= 5 and mean < -0.05").select("key", "move", F.lit(True).alias("hit"))
    judged = e.where("not older").join(flagged, ["key", "move"], "left").groupBy(F.coalesce("hit", F.lit(False)).alias("flagged"))
    return judged.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("r"), 6).alias("mean"))


@query("SELECT count(*) AS shared FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def q104_overlap(spark, sf_dir):
    """Keys that two runs have in common."""
    orders = table(spark, sf_dir, "orders")
    one, two = (orders.where(F.col("o_orderstatus") == s).select("o_custkey") for s in "FP")
    return one.intersect(two).agg(F.count(F.lit(1)).alias("shared"))
