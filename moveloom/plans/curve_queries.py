"""Falls, turning points, crossings, runs, clocks and other features of score curves."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import curves as C
from ..operators.scans import scan
from ..sources.tables import curves
from .registry import CURVES, query


def r(column, digits=6):
    return F.round(column, digits)


@query(f"WITH {CURVES} SELECT game, ply, round(score - lead(score) OVER (PARTITION BY game ORDER BY ply), 6) AS fall, round(score - lead(score, 2) OVER (PARTITION BY game ORDER BY ply), 6) AS fall2 FROM c")
def q40_falls(spark, sf_dir):
    both = C.falls(C.falls(curves(spark, sf_dir), "game", "ply", "score", 2).withColumnRenamed("fall", "fall2"), "game", "ply", "score")
    return both.select("game", "ply", r("fall").alias("fall"), r("fall2").alias("fall2"))


@query(f"WITH {CURVES}, m AS (SELECT game, ply, max(score) OVER (PARTITION BY game ORDER BY ply ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS most FROM c) SELECT game, min(ply) FILTER (most <= -10) AS turn FROM m GROUP BY game")
def q41_turning_point(spark, sf_dir):
    return C.turning_point(curves(spark, sf_dir), "game", "ply", "score", -10)


@query(f"""WITH {CURVES}, x AS (SELECT game, min(ply) FILTER (score >= 150) AS crossing FROM c GROUP BY game)
SELECT c.game, x.crossing, count(*) FILTER (c.ply < x.crossing AND c.ply >= x.crossing - 24 AND c.score < 0) AS low_before FROM c JOIN x ON c.game = x.game GROUP BY ALL""")
def q42_first_crossing(spark, sf_dir):
    """First ply at the level, and how many low plies lie in the 24 before."""
    c = curves(spark, sf_dir)
    w = Window.partitionBy("game")
    marked = c.withColumn("crossing", F.min(F.when(F.col("score") >= 150, F.col("ply"))).over(w))
    low = (F.col("ply") < F.col("crossing")) & (F.col("ply") >= F.col("crossing") - 24) & (F.col("score") < 0)
    return marked.groupBy("game", "crossing").agg(F.sum(F.when(low, 1).otherwise(0)).cast("long").alias("low_before"))


@query(f"""WITH {CURVES}, f AS (SELECT game, ply, score - lead(score) OVER (PARTITION BY game ORDER BY ply) AS fall FROM c)
SELECT game, arg_max(ply, (fall, -ply)) AS worst_ply, round(max(fall), 6) AS worst_value FROM f WHERE fall IS NOT NULL GROUP BY game""")
def q43_worst_fall(spark, sf_dir):
    w = C.worst(C.falls(curves(spark, sf_dir), "game", "ply", "score"), "game", "ply", "fall")
    return w.select("game", "worst_ply", r("worst_value").alias("worst_value"))


@query(f"""WITH {CURVES}, i AS (SELECT *, sum(CASE WHEN score > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY game ORDER BY ply) AS island FROM c)
SELECT game, min(ply) AS start, max(ply) AS "end", count(*) AS length FROM i WHERE score > 0 GROUP BY game, island HAVING count(*) >= 3""")
def q44_runs(spark, sf_dir):
    """Runs of at least three plies ahead: what adjudication waits for."""
    return C.runs(curves(spark, sf_dir), "game", "ply", F.col("score") > 0).where("length >= 3")


@query(f"WITH {CURVES} SELECT game, ply, round(greatest(max(score) OVER (PARTITION BY game ORDER BY ply), 0), 6) AS running FROM c")
def q45_running_max(spark, sf_dir):
    return C.running_max(curves(spark, sf_dir), "game", "ply", "score", 0.0).select("game", "ply", r("running").alias("running"))


@query(f"WITH {CURVES} SELECT game, kind, ply, round(lag(score) OVER (PARTITION BY game, kind ORDER BY ply) + 2.0 - score, 6) AS spent, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY game ORDER BY ply) AS gap FROM c")
def q46_time_per_side(spark, sf_dir):
    c = C.think_time(curves(spark, sf_dir), "game", "kind", ["ply"], "score", 2.0)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return c.select("game", "kind", "ply", r("spent").alias("spent"), (micros - F.lag(micros).over(Window.partitionBy("game").orderBy("ply"))).alias("gap"))


@query(f"WITH {CURVES} SELECT game, ply, score > coalesce(lag(score, 2) OVER w, lag(score, 4) OVER w) AS improving FROM c WINDOW w AS (PARTITION BY game ORDER BY ply)")
def q47_improving(spark, sf_dir):
    return C.improving(curves(spark, sf_dir), "game", "ply", "score").select("game", "ply", "improving")


@query(f"WITH {CURVES}, f AS (SELECT game, ply, score - lead(score) OVER (PARTITION BY game ORDER BY ply) AS fall FROM c) SELECT game, ply, round(max(fall) OVER (PARTITION BY game ORDER BY ply ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), 6) AS tail FROM f")
def q48_trailing_window(spark, sf_dir):
    last = Window.partitionBy("game").orderBy("ply").rowsBetween(-11, 0)
    return C.falls(curves(spark, sf_dir), "game", "ply", "score").select("game", "ply", r(F.max("fall").over(last)).alias("tail"))


@query(f"WITH {CURVES} SELECT game, kind, row_number() OVER (PARTITION BY game ORDER BY max(score) DESC, kind) AS place, round(max(score), 6) AS best FROM c GROUP BY game, kind QUALIFY place <= 3")
def q49_rank_by_score(spark, sf_dir):
    """Candidates ranked by score, ties by name, the first three."""
    best = curves(spark, sf_dir).groupBy("game", "kind").agg(F.max("score").alias("b"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy("game").orderBy(F.desc("b"), "kind")).cast("long")).where("place <= 3").select("game", "kind", "place", r("b").alias("best"))


@query(f"WITH {CURVES}, n AS (SELECT *, max(score) OVER (PARTITION BY game) AS best FROM c WHERE ply <= 10) SELECT game, ply FROM n WHERE score >= best - 40")
def q50_near_best(spark, sf_dir):
    """Choices within a margin of the best of the first ten."""
    near = curves(spark, sf_dir).where("ply <= 10").withColumn("best", F.max("score").over(Window.partitionBy("game")))
    return near.where(F.col("score") >= F.col("best") - 40).select("game", "ply")


@query("""SELECT lane, job, hours, round(sum(hours) OVER (PARTITION BY lane ORDER BY job) - hours, 6) AS starts FROM
(SELECT o_orderpriority AS lane, o_orderkey AS job, round(o_totalprice / 100000.0, 3) AS hours FROM orders WHERE o_orderstatus = 'O')""")
def q51_lane_schedule(spark, sf_dir):
    """When each queued job starts if its lane works first in, first out."""
    from ..sources.tables import table

    jobs = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderpriority").alias("lane"), F.col("o_orderkey").alias("job"), F.round(F.col("o_totalprice") / 100000.0, 3).alias("hours"))
    run = scan(jobs, ["lane"], [F.col("job")], {"upto": F.col("hours")})
    return run.select("lane", "job", "hours", r(F.col("upto") - F.col("hours")).alias("starts"))
