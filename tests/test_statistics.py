"""Closed-form answers for ratings, intervals, medians and samples."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from moveloom.functions import scalars
from moveloom.operators import calibrate, curves, ratings, sampling, sequences


def pairs(spark, points):
    return spark.createDataFrame([(i, float(p)) for i, p in enumerate(points)], "pair long, a_points double")


def test_drawn_pairs_have_no_margin(spark):
    r = ratings.pentanomial(pairs(spark, [1] * 10)).first()
    assert [r[f"bin{k}"] for k in range(5)] == [0, 0, 10, 0, 0]
    assert (r.score, r.elo, r.margin) == (0.5, 0, 0)


def test_won_pairs(spark):
    r = ratings.pentanomial(pairs(spark, [2, 2, 1, 1])).first()
    assert [r[f"bin{k}"] for k in range(5)] == [0, 0, 2, 0, 2]
    assert r.score == 0.75 and abs(r.elo - 190.85) < 0.1


def test_pairs_narrow_the_interval(spark):
    paired = ratings.pentanomial(pairs(spark, [1, 1, 1.5, 0.5] * 25)).first()
    single = ratings.elo_interval(spark.createDataFrame([(50, 100, 50)], "wins long, draws long, losses long")).first()
    assert paired.margin < single.margin


@pytest.mark.parametrize("wdl, elo, margin", [((312, 29, 59), 259, 44), ((346, 920, 234), 26, 18)])
def test_published_results(spark, wdl, elo, margin):
    r = ratings.elo_interval(spark.createDataFrame([wdl], "wins long, draws long, losses long")).first()
    assert abs(r.elo - elo) < 1 and abs(r.margin - margin) < 1.5


def test_llr_without_wins_is_zero(spark):
    df = spark.createDataFrame([(0, 5, 5), (5, 5, 0)], "w long, d long, l long")
    assert [r[0] for r in df.select(ratings.trinomial_llr(F.col("w"), F.col("d"), F.col("l"), 0.0, 5.0)).collect()] == [0.0, 0.0]


def test_equal_players_rate_equal():
    class Cells:
        def groupBy(self, *_):
            return self

        agg = groupBy

        def collect(self):
            from types import SimpleNamespace as N

            return [N(a="x", b="y", score=5.0, n=10), N(a="y", b="z", score=5.0, n=10)]

    assert all(abs(e) < 1e-3 for _, e in ratings.bradley_terry(Cells()))


def test_anchored_rating_of_even_score():
    assert abs(ratings.anchored_rating(np.full(100, 2500.0), np.full(100, 0.5)) - 2500) < 1e-6


def test_half_even(spark):
    assert [r[0] for r in spark.createDataFrame([(2.5,), (3.5,)], "x double").select(scalars.half_even(F.col("x"))).collect()] == [2, 4]


def test_floor_and_truncation(spark):
    r = spark.createDataFrame([(-7.0,)], "x double").select(scalars.floor_div(F.col("x"), 2).alias("f"), scalars.truncated(F.col("x"), 2.0).alias("t")).first()
    assert (r.f, r.t) == (-4, -3)


def test_upper_median(spark):
    df = spark.createDataFrame([(1, v, v) for v in (1, 2, 3, 4)], "g int, v int, k int")
    assert calibrate.upper_median(df, ["g"], "v", "k").first().median == 3


@pytest.mark.parametrize("votes, want", [("aabbc", None), ("aaa", None), ("aaab", "a"), ("bbbaaa", "b")])
def test_consensus(spark, votes, want):
    df = spark.createDataFrame([(1, v, i) for i, v in enumerate(votes)], "p int, a string, o int")
    assert calibrate.consensus(df, "p", "a", "o", 3, 4).first().consensus == want


def test_last_equal_line_wins_and_short_games_do_not_match(spark):
    lines = spark.createDataFrame([(1, 1, "a"), (2, 1, "a"), (3, 3, "a b c")], "id long, k int, prefix string")
    games = spark.createDataFrame([(10, ["a", "b"]), (11, ["x"])], "game long, moves array<string>")
    got = {r.game: (r.line, r.depth) for r in sequences.longest_prefix(games, lines, (1, 2, 3)).collect()}
    assert got == {10: (2, 1), 11: (-1, 0)}


def test_sign_balance_keeps_zeros_and_evens_signs(spark):
    rows = spark.createDataFrame([(i, float(s)) for i, s in enumerate((-3, 0, 0, 5, 7))], "id long, score double")
    kept = sorted(r.score for r in sampling.sign_balance(rows, "score", "id", (0, 25), 1).collect())
    assert kept.count(0.0) == 2 and kept[0] == -3 and len(kept) == 4


def test_equal_shares_need_every_stratum(spark):
    rows = spark.createDataFrame([(i, "a" if i else "b") for i in range(10)], "id long, s string")
    assert sampling.equal_shares(rows, "s", "id", 4, 1, 2).count() == 0


def test_bootstrap_rates_all_players_from_all_games(spark):
    from random import Random

    from moveloom.plans.rating_queries import bootstrap_ratings

    rng = Random(3)
    games = [(a, b, rng.choice((0.0, 0.5, 1.0, 1.0))) for a in (1, 4, 9, 20) for b in (1, 4, 9, 20) if a != b for _ in range(12)]
    got = {r.a: r for r in bootstrap_ratings(spark.createDataFrame(games, "a int, b int, score double")).collect()}
    assert set(got) == {1, 4, 9, 20}

    def rating(player, sample):
        own = [(b, s) for a, b, s in sample if a == player] + [(a, 1 - s) for a, b, s in sample if b == player]
        return ratings.anchored_rating(np.array([2000.0 + 10 * b for b, _ in own]), np.array([s for _, s in own]))

    samples = [[games[rng.randrange(len(games))] for _ in games] for _ in range(1000)]
    for player, r in got.items():
        low, high = np.percentile([rating(player, sample) for sample in samples], [2.5, 97.5])
        assert r.elo == pytest.approx(rating(player, games), abs=0.01) and r.low < r.elo < r.high
        assert r.low == pytest.approx(low, abs=12) and r.high == pytest.approx(high, abs=12)


def test_bootstrap_query_has_every_player(spark):
    from moveloom.plans import registry
    from moveloom.sources.tables import pairings

    games = pairings(spark, "/root/testdata/sf0.001")
    got = registry.QUERIES["q71_bootstrap_rating"](spark, "/root/testdata/sf0.001")
    assert {r.a for r in got.collect()} == {r.a for r in games.select("a").union(games.select("b")).distinct().collect()}


def test_quarantine_lists_every_hit(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "f string")
    with pytest.raises(ValueError, match="a.*b"):
        sampling.refuse_quarantined(rows, rows, "f")


def test_quarantine_counts_what_it_does_not_list(spark):
    rows = spark.range(1003).select(F.col("id").alias("f"))
    with pytest.raises(ValueError, match="1003 quarantined inputs, the first 1000"):
        sampling.refuse_quarantined(rows, rows, "f")


def test_colours_flip(spark):
    """Swapping the sides of every game turns the sign of the rating."""
    one = ratings.elo_interval(spark.createDataFrame([(30, 10, 20)], "wins long, draws long, losses long")).first()
    two = ratings.elo_interval(spark.createDataFrame([(20, 10, 30)], "wins long, draws long, losses long")).first()
    assert math.isclose(one.elo, -two.elo) and math.isclose(one.margin, two.margin)


def test_first_maximum_is_the_worst(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, 9.0), (1, 3, 9.0), (1, 4, None)], "g int, ply long, fall double")
    assert curves.worst(df, "g", "ply", "fall").first().worst_ply == 2


def test_joint_ratings_by_closed_form():
    import numpy as np

    from moveloom.operators.ratings import joint_fit

    # B makes 3 of 4 points against the anchored A, C makes 1 of 4 against B: each 400 log10(3) apart
    played, points = np.zeros((1, 3, 3)), np.array([[1.0, 3.0 + 3.0, 1.0]])
    played[0, 0, 1] = played[0, 1, 0] = played[0, 1, 2] = played[0, 2, 1] = 4
    got = joint_fit(played, points, np.array([2000.0, np.nan, np.nan]))[0]
    apart = 400 * np.log10(3)
    assert abs(got[1] - 2000 - apart) < 0.1 and abs(got[2] - 2000) < 0.2


def test_joint_ratings_of_games(spark):
    from moveloom.plans.rating_queries import joint_ratings

    games = [(0, 1, s) for s in (1.0, 0.0, 0.0, 0.0)] * 5 + [(2, 1, s) for s in (1.0, 0.0, 0.0, 0.0)] * 5 + [(3, 0, 1.0)]
    got = {r.a: r for r in joint_ratings(spark.createDataFrame(games, "a int, b int, score double"), {0: 2000.0}, 200).collect()}
    assert set(got) == {1, 2, 3} and abs(got[1].elo - 2190.85) < 0.2 and abs(got[2].elo - 2000) < 0.5 and got[3].elo == 4500.0
    assert all(r.low <= r.elo <= r.high for r in got.values()) and got[1].n == 40 and got[1].points == 30.0 and got[1].high - got[1].low > 50


def test_queue_of_jobs(spark):
    from moveloom.operators.jobs import ready, scheduled

    rows = [(1, "running", "cpu", 8.0, 4.0, None, "./a.net"), (2, "pending", "gpu", None, 2.0, ["a.net"], "b.net"), (3, "pending", "gpu", None, 1.0, None, None), (4, "pending", "cpu", None, None, ["b.net"], None),
            (5, "pending", "cpu", None, 1.0, [], None), (6, "running", "gpu", 1.0, 2.0, None, "c.net")]
    queue = spark.createDataFrame(rows, "id int, state string, lane string, started double, hours double, requires array<string>, makes string")
    got = {r.id: (r.start, r.finish) for r in scheduled(queue, 10.0).collect()}
    assert got[1] == (8.0, 12.0) and got[2] == (12.0, 14.0) and got[3] == (14.0, 15.0) and got[4] == (14.0, None) and got[5] == (12.0, 13.0) and got[6] == (1.0, 10.0 + 1 / 6)
    files = spark.createDataFrame([("a.net",)], "path string")
    assert {r.id for r in ready(queue, files).collect()} == {2, 3, 5}


def test_matches_of_other_sides_are_not_pooled(spark):
    import pytest

    from moveloom.operators.ratings import pooled_matches

    with pytest.raises(ValueError, match="same sides"):
        pooled_matches(spark.createDataFrame([(1, "a-b", 1.0), (2, "a-c", 1.0)], "m int, s string, a_points double"), "m", "s")
