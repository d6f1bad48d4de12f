"""Medians, committees and scale fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import clamp, expected_score, logit, sigmoid
from ..operators import calibrate as K
from ..sources.tables import curves, table
from .registry import CURVES, query

KINDS = "(SELECT kind, row_number() OVER (ORDER BY kind) AS o FROM (SELECT DISTINCT kind FROM c))"


@query(f"WITH {CURVES}, p AS (SELECT *, row_number() OVER (PARTITION BY game ORDER BY score, event_id) AS rn, count(*) OVER (PARTITION BY game) AS n FROM c) SELECT game, round(score, 6) AS median, n FROM p WHERE rn = n // 2 + 1")
def q52_upper_median(spark, sf_dir):
    return K.upper_median(curves(spark, sf_dir), ["game"], "score", "event_id").withColumn("median", F.round("median", 6))


@query(f"""WITH {CURVES}, p AS (SELECT *, row_number() OVER (PARTITION BY game ORDER BY score, event_id) AS rn, count(*) OVER (PARTITION BY game) AS n, lead(score) OVER (PARTITION BY game ORDER BY score, event_id) AS nxt FROM c),
j AS (SELECT *, greatest(1, least((n + 1) // 4, n - 1)) AS j FROM p) SELECT game, round(score * (1 - ((n + 1) - j * 4) / 4.0::DOUBLE) + nxt * (((n + 1) - j * 4) / 4.0::DOUBLE), 6) AS quartile FROM j WHERE rn = j AND n > 1""")
def q53_exclusive_quartile(spark, sf_dir):
    return K.exclusive_quartile(curves(spark, sf_dir), ["game"], "score", "event_id", 1).withColumn("quartile", F.round("quartile", 6))


@query(f"""WITH {CURVES}, v AS (SELECT game, kind AS answer, ply FROM c WHERE ply <= 7), k AS (SELECT game, answer, count(*) AS votes, min(ply) AS first FROM v GROUP BY ALL),
t AS (SELECT game, arg_max(answer, (votes, -first)) AS answer, max(votes) AS votes, sum(votes)::BIGINT AS answers, count(*) AS kinds FROM k GROUP BY game)
SELECT game, CASE WHEN votes >= 3 AND answers >= 4 THEN answer END AS consensus, votes, answers, kinds, round(1 - votes::DOUBLE / answers, 6) AS disagreement FROM t""")
def q54_consensus(spark, sf_dir):
    """The mode with its quorum, and how far the committee disagrees."""
    votes = curves(spark, sf_dir).where("ply <= 7").select("game", F.col("kind").alias("answer"), "ply")
    return K.consensus(votes, "game", "answer", "ply", 3, 4).withColumn("disagreement", F.round(1 - F.col("votes") / F.col("answers"), 6))


@query(f"WITH {CURVES}, m AS (SELECT game, quantile_cont(1.0::DOUBLE / (1.0 + exp(-score / 150.0)), 0.5) AS p FROM c GROUP BY game) SELECT game, greatest(-2000, least(2000, round_even(150.0 * ln(p / (1 - p)), 0)))::BIGINT AS pooled FROM m")
def q55_logit_median(spark, sf_dir):
    """The committee's median taken as win probability and turned back."""
    p = curves(spark, sf_dir).groupBy("game").agg(F.percentile(sigmoid(F.col("score"), 150.0), 0.5).alias("p"))
    return p.select("game", clamp(F.rint(logit(F.col("p"), 150.0)), -2000, 2000).cast("long").alias("pooled"))


_XS, _YS = (0.0, 50.0, 100.0, 150.0, 200.0, 250.0), (0.0, 30.0, 75.0, 140.0, 220.0, 400.0)


@query(f"""WITH {CURVES}, b AS (SELECT unnest([0, 1, 2, 3, 4]) AS bin, unnest([0.0, 50.0, 100.0, 150.0, 200.0]) AS low, unnest([50.0, 100.0, 150.0, 200.0, 250.0]) AS high),
x AS (SELECT abs(score) AS x, score * score / 250.0 AS y FROM c),
m AS (SELECT bin, quantile_cont(x, 0.5) AS x, quantile_cont(y, 0.5) AS y, count(*) AS n FROM x JOIN b ON x.x >= low AND x.x <= high GROUP BY bin HAVING count(*) >= 20)
SELECT bin::INT AS bin, round(x, 5) AS x, round(y, 5) AS y, n, round(greatest(max(y) OVER (ORDER BY bin), 0), 5) AS scaled FROM m""")
def q56_bin_medians(spark, sf_dir):
    rows = curves(spark, sf_dir).select(F.abs("score").alias("x"), (F.col("score") * F.col("score") / 250.0).alias("y"))
    out = K.bin_medians(rows, "x", "y", (0, 50, 100, 150, 200, 250), 20)
    return out.select("bin", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"), "n", F.round("scaled", 5).alias("scaled"))


@query(f"""WITH {CURVES}, a AS (SELECT game, ply, score, abs(score) AS a FROM c)
SELECT game, ply, round(sign(score) * CASE WHEN a <= 0 THEN 0 WHEN a <= 50 THEN 0 + a * 0.6 WHEN a <= 100 THEN 30 + (a - 50) * 0.9 WHEN a <= 150 THEN 75 + (a - 100) * 1.3 WHEN a <= 200 THEN 140 + (a - 150) * 1.6 WHEN a <= 250 THEN 220 + (a - 200) * 3.6 ELSE 400 END, 5) AS scaled FROM a""")
def q57_interpolation(spark, sf_dir):
    return curves(spark, sf_dir).select("game", "ply", F.round(K.interpolate(F.col("score"), _XS, _YS), 5).alias("scaled"))


@query(f"""WITH {CURVES}, g AS (SELECT unnest(range(40, 401, 40))::DOUBLE AS k), l AS (SELECT k, round(avg(pow(1.0 / (1.0 + exp(-score / k)) - 1.0 / (1.0 + exp(-score / 150.0)), 2)), 9) AS loss FROM c, g GROUP BY k)
SELECT k AS parameter, loss FROM l ORDER BY loss, k LIMIT 1""")
def q58_grid_least_squares(spark, sf_dir):
    return K.grid_fit(curves(spark, sf_dir), range(40, 401, 40), lambda k: F.pow(1.0 / (1.0 + F.exp(-F.col("score") / k)) - sigmoid(F.col("score"), 150.0), 2.0))


@query(f"""WITH {CURVES}, g AS (SELECT unnest(range(50, 501, 50))::DOUBLE AS k), y AS (SELECT score, CASE WHEN event_id % 3 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS y FROM c),
l AS (SELECT k, round(avg(-(y * ln(greatest(1e-6, least(1 - 1e-6, 1.0 / (1.0 + pow(10.0, -score / k))))) + (1 - y) * ln(1 - greatest(1e-6, least(1 - 1e-6, 1.0 / (1.0 + pow(10.0, -score / k))))))), 9) AS loss FROM y, g GROUP BY k)
SELECT k AS parameter, loss FROM l ORDER BY loss, k LIMIT 1""")
def q59_grid_log_loss(spark, sf_dir):
    rows = curves(spark, sf_dir).withColumn("y", F.when(F.col("event_id") % 3 == 0, 0.0).otherwise(1.0))

    def loss(k):
        p = clamp(1.0 / (1.0 + F.pow(F.lit(10.0), -F.col("score") / k)), 1e-6, 1 - 1e-6)
        return -(F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p))

    return K.grid_fit(rows, range(50, 501, 50), loss)


@query("SELECT count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS corr, round(sqrt(avg(pow(l_extendedprice / 1000.0 - l_quantity, 2))), 4) AS rms FROM lineitem")
def q60_correlation(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("corr"), F.round(F.sqrt(F.avg(F.pow(F.col("l_extendedprice") / 1000.0 - F.col("l_quantity"), 2.0))), 4).alias("rms"))


@query(f"""WITH {CURVES}, h AS (SELECT score, (('0x' || substr(sha1(event_id::VARCHAR), 1, 2))::INT) % 10 = 0 AS held FROM c)
SELECT held, count(*) AS n, round(avg(pow(1.0 / (1.0 + exp(-score / 180.0)) - 1.0 / (1.0 + exp(-score / 150.0)), 2)), 9) AS loss, round(avg(abs(score * 150.0 / 180.0 - score)), 5) AS error FROM h GROUP BY held""")
def q61_holdout_loss(spark, sf_dir):
    from ..operators.sampling import held_out

    rows = curves(spark, sf_dir).select("score", held_out(F.col("event_id")).alias("held"))
    return rows.groupBy("held").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.pow(sigmoid(F.col("score"), 180.0) - sigmoid(F.col("score"), 150.0), 2.0)), 9).alias("loss"), F.round(F.avg(F.abs(F.col("score") * 150.0 / 180.0 - F.col("score"))), 5).alias("error"))


@query(f"""WITH {CURVES}, b AS (SELECT game, ply, score > 0 AS a, ply % 2 = 0 AS b FROM c) SELECT (count(*) FILTER (a AND NOT b))::BIGINT AS only_a, (count(*) FILTER (b AND NOT a))::BIGINT AS only_b,
round(CASE WHEN count(*) FILTER (a <> b) = 0 THEN 0 ELSE ((count(*) FILTER (a AND NOT b)) - (count(*) FILTER (b AND NOT a))) / sqrt(count(*) FILTER (a <> b)) END, 6) AS z FROM b""")
def q62_mcnemar(spark, sf_dir):
    """Two runs on the same items: how far their disagreements lean."""
    x = curves(spark, sf_dir).select((F.col("score") > 0).alias("a"), (F.pmod("ply", F.lit(2)) == 0).alias("b"))
    n = x.agg(F.sum((F.col("a") & ~F.col("b")).cast("long")).alias("only_a"), F.sum((F.col("b") & ~F.col("a")).cast("long")).alias("only_b"))
    total = F.col("only_a") + F.col("only_b")
    return n.withColumn("z", F.round(F.when(total == 0, 0.0).otherwise((F.col("only_a") - F.col("only_b")) / F.sqrt(total)), 6))


@query(f"WITH {CURVES} SELECT game, round(avg(score), 6) AS mean, round(avg(CASE WHEN abs(score) >= 50 THEN 1.0 ELSE 0.0 END), 6) AS share50, round(avg(CASE WHEN abs(score) >= 200 THEN 1.0 ELSE 0.0 END), 6) AS share200, round(avg(1.0 / (1.0 + pow(10.0, -score / 400.0))), 6) AS expected FROM c GROUP BY game")
def q63_threshold_shares(spark, sf_dir):
    at = lambda v: F.round(F.avg(F.when(F.abs("score") >= v, 1.0).otherwise(0.0)), 6)
    return curves(spark, sf_dir).groupBy("game").agg(F.round(F.avg("score"), 6).alias("mean"), at(50).alias("share50"), at(200).alias("share200"), F.round(F.avg(expected_score(F.col("score"))), 6).alias("expected"))


@query("""WITH g AS (SELECT unnest(range(40, 401)) / 100.0::DOUBLE AS f), x AS (SELECT value AS x, value * 1.7::DOUBLE + (event_id % 7) AS y FROM events),
l AS (SELECT f, round(avg(pow(f * x - y, 2)), 6) AS loss FROM x, g GROUP BY f) SELECT f AS parameter, loss FROM l ORDER BY loss, f LIMIT 1""")
def q136_grid_factor(spark, sf_dir):
    """The factor from 0.40 to 4.00 that brings one scale nearest to another, all tried in one pass."""
    from ..sources.tables import table

    rows = table(spark, sf_dir, "events").select(F.col("value").alias("x"), (F.col("value") * 1.7 + F.col("event_id") % 7).alias("y"))
    best = K.grid_fit(rows, [k / 100 for k in range(40, 401)], lambda f: F.pow(F.col("x") * f - F.col("y"), 2.0))
    return best.select("parameter", F.round("loss", 6).alias("loss"))
