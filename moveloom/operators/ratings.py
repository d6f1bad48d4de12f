"""Ratings, intervals and sequential tests over paired trials."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import elo_of, expected_score
from ..sources.folders import written
from .scans import rank_rows, scan, tasks_for

Z95 = 1.96


def tally(score: Column) -> list[Column]:
    return [F.sum(F.when(score == v, 1).otherwise(0)).cast("long").alias(n) for v, n in ((1.0, "wins"), (0.5, "draws"), (0.0, "losses"))]


def _margin(score: Column, error: Column, edge: float) -> Column:
    """Half the width of the rating interval around a score, kept off 0 and 1."""
    low, high = F.greatest(score - Z95 * error, F.lit(edge)), F.least(score + Z95 * error, F.lit(1 - edge))
    return (elo_of(high) - elo_of(low)) / 2


def elo_interval(df: DataFrame) -> DataFrame:
    """(wins, draws, losses) with n, score, elo and margin at 95 %, by the binomial error of the score.

    A score of 0 or 1 has an infinite rating and margin 0.
    """
    n = F.col("wins") + F.col("draws") + F.col("losses")
    out = df.withColumn("n", n).withColumn("score", (F.col("wins") + 0.5 * F.col("draws")) / n)
    score = F.col("score")
    inside = (score > 0) & (score < 1)
    elo = F.when(score <= 0, float("-inf")).when(score >= 1, float("inf")).otherwise(elo_of(score))
    error = F.sqrt(score * (1 - score) / F.col("n"))
    return out.withColumn("elo", elo).withColumn("margin", F.when(inside, _margin(score, error, 1e-6)).otherwise(F.lit(0.0)))


def trinomial_llr(wins: Column, draws: Column, losses: Column, elo0: float, elo1: float) -> Column:
    """Log likelihood ratio by the normal model; 0 without a win or a loss, or without variance."""
    n = (wins + draws + losses).cast("double")
    mean = (wins + 0.5 * draws) / n
    variance = (wins + 0.25 * draws) / n - mean * mean
    s0, s1 = (1 / (1 + 10 ** (-e / 400)) for e in (elo0, elo1))
    value = n * (s1 - s0) * (2 * mean - s0 - s1) / (2 * variance)
    return F.when((wins == 0) | (losses == 0) | (variance <= 0), F.lit(0.0)).otherwise(value)


def pair_up(games: DataFrame, opening: str, a_white: str, seq: str, points: str) -> DataFrame:
    """Games of one opening with opposite colours, first come first paired: (opening, pair, a_points)."""
    numbered = written(rank_rows(games, [opening, a_white], [F.col(seq)], "pair"))
    tasks = tasks_for(numbered)

    def side(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.select(opening, "pair", F.col(points).alias(name))
        return rows.repartition(tasks, opening, "pair") if tasks else rows

    return side(numbered.where(F.col(a_white)), "_w").join(side(numbered.where(~F.col(a_white)), "_b"), [opening, "pair"]).select(opening, "pair", (F.col("_w") + F.col("_b")).alias("a_points"))


def pentanomial(pairs: DataFrame, *by: str) -> DataFrame:
    """Five bins of pair points, the score, its Elo and the margin from the population variance of pairs."""
    bins = [F.sum(F.when(F.col("a_points") == k / 2, 1).otherwise(0)).cast("long").alias(f"bin{k}") for k in range(5)]
    out = pairs.groupBy(*by).agg(*bins, F.count(F.lit(1)).alias("pairs"), F.avg(F.col("a_points") / 2).alias("score"), F.var_pop(F.col("a_points") / 2).alias("variance"))
    error = F.sqrt(F.col("variance") / F.col("pairs"))
    bounded = F.greatest(F.least(F.col("score"), F.lit(1 - 1e-9)), F.lit(1e-9))
    return out.withColumn("elo", elo_of(bounded)).withColumn("margin", _margin(F.col("score"), error, 1e-9))


def pooled_matches(pairs: DataFrame, match: str, sides: str) -> DataFrame:
    """Pentanomial of all pairs (a_points) of several matches; matches of other sides than the first's are an error."""
    pairs = written(pairs)
    first = pairs.agg(F.min(sides).alias("low"), F.max(sides).alias("high")).first()
    if first.low != first.high:
        raise ValueError(f"these matches are not between the same sides: {first.low}, {first.high}")
    matches = pairs.agg(F.count_distinct(match).alias("matches")).first().matches
    return pentanomial(pairs.withColumn("_all", F.lit(1)), "_all").drop("_all").withColumn("matches", F.lit(matches).cast("long"))


def running_llr(trials: DataFrame, by: str, order: list[str], points: str, s0: float, s1: float) -> DataFrame:
    """Normal-model ratio after each trial, from running sums over ranges, so that a group of any size is in many tasks."""
    run = scan(trials, [by], [F.col(c) for c in order], {"k": F.lit(1).cast("long"), "_s": F.col(points), "_q": F.col(points) * F.col(points)})
    mean = F.col("_s") / F.col("k")
    variance = F.col("_q") / F.col("k") - mean * mean
    value = F.col("k") * (s1 - s0) * (2 * mean - s0 - s1) / (2 * variance)
    return run.withColumn("llr", F.when(variance <= 1e-12, F.lit(0.0)).otherwise(value)).drop("_s", "_q")


def first_crossing(run: DataFrame, by: str, least: int, alpha: float = 0.05, beta: float = 0.05) -> DataFrame:
    bound = math.log((1 - beta) / alpha)
    crossed = (F.col("k") >= least) & (F.abs("llr") >= bound)
    return run.groupBy(by).agg(F.count(F.lit(1)).alias("trials"), F.min(F.when(crossed, F.col("k"))).alias("stopped_at"))


def pooled(rows: DataFrame, estimate: str, error: str) -> DataFrame:
    """Inverse-variance mean; the error is scaled up where the estimates scatter more than their errors allow.

    Errors are standard errors. Of half-widths of 95 % intervals, pass them divided by 1.96 and multiply the result's.
    """
    w = 1 / (F.col(error) * F.col(error))
    sums = rows.agg(F.sum(w).alias("w"), F.sum(w * F.col(estimate)).alias("wx"), F.sum(w * F.col(estimate) * F.col(estimate)).alias("wxx"), F.count(F.lit(1)).alias("n"))
    mean = F.col("wx") / F.col("w")
    spread = F.when(F.col("n") > 1, (F.col("wxx") - F.col("w") * mean * mean) / (F.col("n") - 1)).otherwise(F.lit(1.0))
    return sums.select("n", mean.alias("mean"), (F.sqrt(1 / F.col("w")) * F.sqrt(F.greatest(spread, F.lit(1.0)))).alias("error"))


def bradley_terry(cells: DataFrame, rounds: int = 500, tolerance: float = 1e-6) -> list[tuple[str, float]]:
    """Ratings from (a, b, score, n): players squared at most reach the driver, which solves the likelihood by fixed points."""
    rows = cells.groupBy("a", "b").agg(F.sum("score").alias("score"), F.sum("n").alias("n")).collect()
    names = sorted({r.a for r in rows} | {r.b for r in rows})
    at = {p: i for i, p in enumerate(names)}
    wins, games = np.zeros((len(names),) * 2), np.zeros((len(names),) * 2)
    for r in rows:
        wins[at[r.a], at[r.b]] += r.score
        wins[at[r.b], at[r.a]] += r.n - r.score
        games[at[r.a], at[r.b]] += r.n
        games[at[r.b], at[r.a]] += r.n
    np.fill_diagonal(wins, 0)
    np.fill_diagonal(games, 0)
    strength = np.ones(len(names))
    total = np.clip(wins.sum(axis=1), 1e-9, None)
    for _ in range(rounds):
        new = total / np.maximum((games / (strength[:, None] + strength[None, :])).sum(axis=1), 1e-12)
        new /= np.exp(np.log(new).mean())
        done = np.abs(np.log(new / strength)).max() < tolerance
        strength = new
        if done:
            break
    return [(p, float(400 * math.log10(s))) for p, s in zip(names, strength, strict=True)]


def anchored_rating(opponent: np.ndarray, score: np.ndarray, steps: int = 60) -> float:
    """Rating whose expected points equal the points made, by Newton steps of at most 200 within 1000 to 4500."""
    r, k = float(np.mean(opponent)), math.log(10) / 400
    for _ in range(steps):
        p = 1 / (1 + 10 ** ((opponent - r) / 400))
        slope = k * float((p * (1 - p)).sum())
        move = float((score - p).sum()) / max(slope, 1e-9)
        r = min(max(r + max(min(move, 200.0), -200.0), 1000.0), 4500.0)
        if abs(move) < 1e-9:
            break
    return r


def anchored_ratings(opponent: np.ndarray, score: np.ndarray, times: np.ndarray, steps: int = 60) -> np.ndarray:
    """anchored_rating() of each row of `times`, which says how often each game counts."""
    k = math.log(10) / 400
    r = times @ opponent / np.maximum(times.sum(axis=1), 1)
    for _ in range(steps):
        p = 1 / (1 + 10 ** ((opponent - r[:, None]) / 400))
        slope = k * (times * p * (1 - p)).sum(axis=1)
        move = (times * (score - p)).sum(axis=1) / np.maximum(slope, 1e-9)
        r = np.clip(r + np.clip(move, -200.0, 200.0), 1000.0, 4500.0)
        if np.abs(move).max() < 1e-9:
            break
    return r


def joint_fit(played: np.ndarray, points: np.ndarray, given: np.ndarray, rounds: int = 200, tolerance: float = 0.01) -> np.ndarray:
    """Ratings at which all players without a given one make the points expected of them, for each replicate.

    played: games by replicate, player and opponent, from either side; points: by replicate and player. Players take
    turns, each by Newton steps of at most 200 within 1000 to 4500 from 2500 on, until none moves by the tolerance.
    """
    k = math.log(10) / 400
    ratings = np.where(np.isnan(given), 2500.0, given)[None, :].repeat(len(played), axis=0)
    free = np.flatnonzero(np.isnan(given))
    for _ in range(rounds):
        before = ratings.copy()
        for i in free:
            n = played[:, i, :]
            for _ in range(20):
                p = 1 / (1 + 10 ** ((ratings - ratings[:, [i]]) / 400))
                slope = k * (n * p * (1 - p)).sum(axis=1)
                step = np.where(slope > 0, np.clip((points[:, i] - (n * p).sum(axis=1)) / np.maximum(slope, 1e-300), -200.0, 200.0), 0.0)
                moved = np.clip(ratings[:, i] + step, 1000.0, 4500.0)
                done = np.abs(moved - ratings[:, i]).max() < tolerance / 10
                ratings[:, i] = moved
                if done:
                    break
        if np.abs(ratings - before).max() < tolerance:
            break
    return ratings


def residual(score: Column, difference: Column) -> Column:
    return score - expected_score(difference)
