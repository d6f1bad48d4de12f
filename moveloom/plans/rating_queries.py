"""Ratings, intervals, pair statistics and sequential tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import expected_score
from ..operators import ratings as R
from ..operators.scans import scan
from ..sources.tables import pairings, table
from .registry import PAIRINGS, query

_E = "CASE WHEN {x} > 0 AND {x} < 1 THEN -400.0 * log10(1.0 / ({x}) - 1.0) END"
_WDL = f"WITH {PAIRINGS}, w AS (SELECT a, (count(*) FILTER (score = 1))::BIGINT AS wins, (count(*) FILTER (score = 0.5))::BIGINT AS draws, (count(*) FILTER (score = 0))::BIGINT AS losses, count(*) AS n FROM p GROUP BY a)"
_LOW, _HIGH = "greatest(score - 1.96::DOUBLE * se, 1e-6)", "least(score + 1.96::DOUBLE * se, 1 - 1e-6)"


def tallies(spark, sf_dir):
    return pairings(spark, sf_dir).groupBy("a").agg(*R.tally(F.col("score")))


@query(f"""{_WDL}, s AS (SELECT *, (wins + 0.5::DOUBLE * draws) / n AS score FROM w), e AS (SELECT *, sqrt(score * (1 - score) / n) AS se FROM s)
SELECT a, wins, draws, losses, n, round(score, 6) AS score, round({_E.format(x='score')}, 4) AS elo, round(({_E.format(x=_HIGH)} - {_E.format(x=_LOW)}) / 2, 4) AS margin FROM e""")
def q64_elo_interval(spark, sf_dir):
    out = R.elo_interval(tallies(spark, sf_dir))
    return out.select("a", "wins", "draws", "losses", "n", F.round("score", 6).alias("score"), F.round("elo", 4).alias("elo"), F.round("margin", 4).alias("margin"))


_S0, _S1 = (1 / (1 + 10 ** (-e / 400)) for e in (0.0, 5.0))


@query(f"""{_WDL}, m AS (SELECT *, (wins + 0.5::DOUBLE * draws) / n AS mean, (wins + 0.25::DOUBLE * draws) / n AS sq FROM w)
SELECT a, round(CASE WHEN wins = 0 OR losses = 0 OR sq - mean * mean <= 0 THEN 0 ELSE n * ({_S1!r}::DOUBLE - {_S0!r}::DOUBLE) * (2 * mean - {_S0!r}::DOUBLE - {_S1!r}::DOUBLE) / (2 * (sq - mean * mean)) END, 6) AS llr FROM m""")
def q65_trinomial_llr(spark, sf_dir):
    t = tallies(spark, sf_dir)
    return t.select("a", F.round(R.trinomial_llr(F.col("wins"), F.col("draws"), F.col("losses"), 0.0, 5.0), 6).alias("llr"))


_PAIRS = f"""{PAIRINGS}, q AS (SELECT opening, a < b AS white, CASE WHEN a < b THEN score ELSE 1 - score END AS points, row_number() OVER (PARTITION BY opening, a < b ORDER BY l_orderkey, l_linenumber, l_partkey, a, b, score) AS pair FROM p),
z AS (SELECT w.opening, w.pair, w.points + b.points AS a_points FROM q w JOIN q b ON w.opening = b.opening AND w.pair = b.pair AND w.white AND NOT b.white)"""


def paired(spark, sf_dir):
    """Games of one opening in turn, those of either colour paired first come, first served."""
    from pyspark.sql import Column

    p = pairings(spark, sf_dir)
    white = F.col("a") < F.col("b")
    points: Column = F.when(white, F.col("score")).otherwise(1 - F.col("score"))
    seq = F.struct("l_orderkey", "l_linenumber", "l_partkey", "a", "b", "score")
    return R.pair_up(p.select("opening", white.alias("white"), points.alias("points"), seq.alias("seq")), "opening", "white", "seq", "points")


@query(f"""WITH {_PAIRS}, s AS (SELECT opening, {', '.join(f'(count(*) FILTER (a_points = {k / 2}))::BIGINT AS bin{k}' for k in range(5))}, count(*) AS pairs, avg(a_points / 2) AS score, var_pop(a_points / 2) AS variance FROM z GROUP BY opening),
e AS (SELECT *, sqrt(variance / pairs) AS se FROM s)
SELECT opening, bin0, bin1, bin2, bin3, bin4, pairs, round(score, 6) AS score, round({_E.format(x='score')}, 4) AS elo, round(({_E.format(x=_HIGH.replace('1e-6', '1e-9'))} - {_E.format(x=_LOW.replace('1e-6', '1e-9'))}) / 2, 4) AS margin FROM e""")
def q66_pentanomial(spark, sf_dir):
    out = R.pentanomial(paired(spark, sf_dir), "opening")
    return out.select("opening", *(f"bin{k}" for k in range(5)), "pairs", F.round("score", 6).alias("score"), F.round("elo", 4).alias("elo"), F.round("margin", 4).alias("margin"))


@query(f"""WITH {_PAIRS}, u AS (SELECT opening, pair, row_number() OVER w AS k, sum(a_points / 2) OVER w AS s, sum(a_points / 2 * (a_points / 2)) OVER w AS q FROM z WINDOW w AS (PARTITION BY opening ORDER BY pair)),
l AS (SELECT opening, k, CASE WHEN q / k - (s / k) * (s / k) <= 1e-12 THEN 0 ELSE k * 0.05 * (2 * s / k - 0.5 - 0.55) / (2 * (q / k - (s / k) * (s / k))) END AS llr FROM u)
SELECT opening, count(*) AS trials, min(k) FILTER (k >= 20 AND abs(llr) >= ln(19.0)) AS stopped_at FROM l GROUP BY opening""")
def q67_running_llr(spark, sf_dir):
    """Where a sequential test over pairs would have stopped."""
    trials = paired(spark, sf_dir).withColumn("points", F.col("a_points") / 2)
    return R.first_crossing(R.running_llr(trials, "opening", ["pair"], "points", 0.5, 0.55), "opening", 20)


@query(f"""{_WDL}, s AS (SELECT *, (wins + 0.5::DOUBLE * draws) / n AS score FROM w), e AS (SELECT score - 0.5 AS x, sqrt((wins * pow(1 - score, 2) + draws * pow(0.5 - score, 2) + losses * pow(score, 2)) / n / n) AS se FROM s),
t AS (SELECT sum(1 / (se * se)) AS w, sum(x / (se * se)) AS wx, sum(x * x / (se * se)) AS wxx, count(*) AS n FROM e)
SELECT n, round(wx / w, 6) AS mean, round(sqrt(1 / w) * sqrt(greatest((wxx - w * (wx / w) * (wx / w)) / (n - 1), 1)), 6) AS error FROM t""")
def q68_pooled_estimate(spark, sf_dir):
    t = R.elo_interval(tallies(spark, sf_dir))
    se = F.sqrt((F.col("wins") * F.pow(1 - F.col("score"), 2.0) + F.col("draws") * F.pow(0.5 - F.col("score"), 2.0) + F.col("losses") * F.pow(F.col("score"), 2.0)) / F.col("n") / F.col("n"))
    out = R.pooled(t.select((F.col("score") - 0.5).alias("x"), se.alias("se")), "x", "se")
    return out.select("n", F.round("mean", 6).alias("mean"), F.round("error", 6).alias("error"))


@query(f"WITH {PAIRINGS} SELECT a, {', '.join(f'round(sum(score) FILTER (b = {k}), 1) AS b{k}' for k in range(25))} FROM p GROUP BY a")
def q69_crosstable(spark, sf_dir):
    """Points of each player against each other one; the SQL has the players of the given tables."""
    players = [r.n_nationkey for r in table(spark, sf_dir, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]
    out = pairings(spark, sf_dir).groupBy("a").pivot("b", players).agg(F.round(F.sum("score"), 1))
    return out.select("a", *(F.col(str(k)).alias(f"b{k}") for k in players))


@query(f"""WITH RECURSIVE {PAIRINGS}, s AS (SELECT a, b, score FROM p UNION ALL SELECT b, a, 1 - score FROM p),
g AS (SELECT a, b, count(*)::DOUBLE AS n FROM s GROUP BY a, b), t AS (SELECT a, sum(score) AS total FROM s GROUP BY a),
v(k, a, v) AS (SELECT 0, a, 1.0::DOUBLE FROM t UNION ALL SELECT k, a, fresh / exp(avg(ln(fresh)) OVER ())
  FROM (SELECT x.k + 1 AS k, x.a, any_value(t.total) / sum(g.n / (x.v + y.v)) AS fresh FROM v x JOIN g ON g.a = x.a JOIN v y ON y.a = g.b JOIN t ON t.a = x.a WHERE x.k < 100 GROUP BY x.k, x.a))
SELECT a::VARCHAR AS player, round(400 * log10(v), 3) AS elo FROM v WHERE k = 100""")
def q70_bradley_terry(spark, sf_dir):
    """Ratings of all players from all games; the likelihood is solved on the players' table of results, in the SQL by a hundred rounds."""
    cells = pairings(spark, sf_dir).groupBy(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")).agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("n"))
    return spark.createDataFrame(R.bradley_terry(cells, tolerance=1e-13), "player string, elo double").withColumn("elo", F.round("elo", 3))


#: Replicates of a bootstrap, as in the reference.
REPLICATES = 2000


@query()
def q71_bootstrap_rating(spark, sf_dir):
    """Anchored ratings of all players with a 95 % bootstrap interval over their games."""
    return bootstrap_ratings(pairings(spark, sf_dir))


def bootstrap_ratings(games, replicates: int = REPLICATES, seed: int = 1):
    """games (a, b, score of a) -> a, elo, low, high of each player, from its games on either side.

    A rating depends only on how many games have which opponent and score, and drawing all games with replacement
    draws these counts from a multinomial; so a player's replicates are drawn from its counts, and no game is copied.
    The percentiles are without the estimate itself and without replicates that drew none of the player's games.
    """
    import numpy as np
    import pandas as pd

    total = games.count()
    sides = games.select("a", "b", "score").union(games.select("b", "a", 1 - F.col("score")))
    cells = sides.groupBy("a", "b", "score").agg(F.count(F.lit(1)).alias("n"))

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["b", "score"])
        opponent, score, n = 2000.0 + 10.0 * pdf.b.to_numpy(float), pdf.score.to_numpy(float), pdf.n.to_numpy()
        rest = max(total - n.sum(), 0)
        drawn = np.random.default_rng([seed, int(key[0])]).multinomial(total, [*(n / total), rest / total], replicates)[:, :-1]
        elo = R.anchored_ratings(opponent, score, np.vstack([n, drawn[drawn.sum(axis=1) > 0]]))
        low, high = np.percentile(elo[1:], [2.5, 97.5])
        return pd.DataFrame({"a": [key[0]], "elo": [elo[0]], "low": [low], "high": [high]})

    fitted = cells.groupBy("a").applyInPandas(fit, "a int, elo double, low double, high double")
    return fitted.select("a", *(F.round(c, 2).alias(c) for c in ("elo", "low", "high")))


@query()
def q127_joint_ratings(spark, sf_dir):
    """Five players are anchored; the others are rated together, their games with each other included, with 95 % of all replicates."""
    return joint_ratings(pairings(spark, sf_dir), {k: 2000.0 + 100.0 * k for k in range(5)})


def joint_ratings(games, anchors: dict[int, float], replicates: int = REPLICATES, seed: int = 1):
    """games (a, b, score of a) -> a, elo, low, high, n, points of each player without an anchor.

    All games are drawn with replacement as counts per pair of players and score, so a replicate is one multinomial
    draw on the players' table of results; that table is all that leaves the executors, and replicates are dealt to them.
    """
    import numpy as np
    import pandas as pd

    spark = games.sparkSession
    cells = sorted((r.a, r.b, r.score, r.n) for r in games.groupBy("a", "b", "score").agg(F.count(F.lit(1)).alias("n")).collect())  # players squared
    players = sorted({x for c in cells for x in c[:2]})
    at = {p: i for i, p in enumerate(players)}
    a, b = (np.array([at[c[k]] for c in cells], int) for k in (0, 1))
    score, n = np.array([c[2] for c in cells], float), np.array([c[3] for c in cells], np.int64)
    given = np.array([anchors.get(p, np.nan) for p in players])

    def fit(counts: np.ndarray) -> np.ndarray:
        played, points = np.zeros((len(counts), len(players), len(players))), np.zeros((len(counts), len(players)))
        for x, y, s in ((a, b, score), (b, a, 1 - score)):
            np.add.at(played, (slice(None), x, y), counts)
            np.add.at(points, (slice(None), x), counts * s)
        return R.joint_fit(played, points, given)

    def run(batches):
        for batch in batches:
            drawn = np.stack([np.random.default_rng([seed, int(i)]).multinomial(n.sum(), n / n.sum()) for i in batch.id])
            elo = fit(drawn)
            yield pd.DataFrame({"at": np.tile(np.arange(len(players)), len(drawn)), "elo": elo.ravel()})

    estimate = fit(n[None, :])[0]
    made = [(p, float(estimate[i]), int(n[(a == i) | (b == i)].sum()), float((score * n)[a == i].sum() + ((1 - score) * n)[b == i].sum())) for p, i in at.items() if p not in anchors]
    drawn = spark.range(0, replicates, 1, max(1, replicates // 100)).mapInPandas(run, "at int, elo double")
    ordered = drawn.groupBy("at").agg(F.array_sort(F.collect_list("elo")).alias("e"))  # a number for each replicate
    low, high = (F.element_at("e", F.greatest(F.floor(F.size("e") * q), F.lit(1)).cast("int")) for q in (0.025, 0.975))
    named = spark.createDataFrame([(at[p], p, e, k, x) for p, e, k, x in made], "at int, a int, elo double, n long, points double")
    return named.join(ordered.select("at", low.alias("low"), high.alias("high")), "at").select("a", *(F.round(c, 2).alias(c) for c in ("elo", "low", "high")), "n", "points")


@query("""WITH n AS (SELECT n_nationkey AS k, n_regionkey AS r FROM nation) SELECT x.k AS a, y.k AS b, o.opening FROM n x JOIN n y ON x.r = y.r AND x.k < y.k, (SELECT DISTINCT o_orderpriority AS opening FROM orders) o""")
def q72_schedule(spark, sf_dir):
    """Round-robin pairings within a region, each with every opening."""
    n = table(spark, sf_dir, "nation")
    x, y = n.select(F.col("n_nationkey").alias("a"), "n_regionkey"), n.select(F.col("n_nationkey").alias("b"), "n_regionkey")
    openings = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("opening")).distinct()
    listed = openings.agg(F.array_sort(F.collect_set("opening")).alias("openings")).first().openings  # a handful by design
    return x.join(y, "n_regionkey").where("a < b").select("a", "b", F.explode(F.array(*map(F.lit, listed))).alias("opening"))


@query(f"""WITH {PAIRINGS} SELECT a, count(*) AS n, round(sum(score - 1.0 / (1.0 + pow(10.0, -((a - b) * 10.0) / 400.0))), 5) AS residual, round(avg(score - 1.0 / (1.0 + pow(10.0, -((a - b) * 10.0) / 400.0))), 6) AS mean,
round(1.96 * stddev_samp(score - 1.0 / (1.0 + pow(10.0, -((a - b) * 10.0) / 400.0))) / sqrt(count(*)), 6) AS half FROM p GROUP BY a""")
def q73_residuals(spark, sf_dir):
    """Results against expectation: mean residual with its interval."""
    x = pairings(spark, sf_dir).withColumn("r", F.col("score") - expected_score((F.col("a") - F.col("b")) * 10.0))
    return x.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("r"), 5).alias("residual"), F.round(F.avg("r"), 6).alias("mean"), F.round(1.96 * F.stddev_samp("r") / F.sqrt(F.count(F.lit(1))), 6).alias("half"))


@query(f"WITH {PAIRINGS} SELECT a, l_orderkey, l_linenumber, l_partkey, b, (sum(CASE WHEN score = 1 THEN 1 ELSE 0 END) OVER w)::BIGINT AS wins, (sum(CASE WHEN score = 0.5 THEN 1 ELSE 0 END) OVER w)::BIGINT AS draws FROM p WINDOW w AS (PARTITION BY a ORDER BY l_orderkey, l_linenumber, l_partkey, b ROWS UNBOUNDED PRECEDING)")
def q74_running_tally(spark, sf_dir):
    """Wins and draws of each player so far, game by game."""
    games = pairings(spark, sf_dir)
    has = lambda v: F.when(F.col("score") == v, 1).otherwise(0).cast("long")
    run = scan(games, ["a"], [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "b")], {"wins": has(1.0), "draws": has(0.5)})
    return run.select("a", "l_orderkey", "l_linenumber", "l_partkey", "b", "wins", "draws")


@query(f"""WITH {_PAIRS}, s AS (SELECT count(*) AS pairs, count(DISTINCT opening) AS matches, (count(*) FILTER (a_points = 0))::BIGINT AS bin0, (count(*) FILTER (a_points = 2))::BIGINT AS bin4, avg(a_points / 2) AS score FROM z)
SELECT matches, pairs, bin0, bin4, round(score, 6) AS score, round({_E.format(x='score')}, 4) AS elo FROM s""")
def q129_pooled_matches(spark, sf_dir):
    """The pairs of all matches of the same two sides as one result."""
    pairs = paired(spark, sf_dir).withColumn("sides", F.lit("a-b"))
    out = R.pooled_matches(pairs, "opening", "sides")
    return out.select("matches", "pairs", "bin0", "bin4", F.round("score", 6).alias("score"), F.round("elo", 4).alias("elo"))
