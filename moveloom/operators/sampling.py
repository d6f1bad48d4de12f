"""Deterministic samples, splits, dedupes and rebalancing. All orders are total, so results repeat on any layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import seeded_order, sha1_bucket
from ..sources.folders import written


def sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement: a top-k by a seeded hash, which each task cuts to n before the merge."""
    return rows.orderBy(seeded_order(F.col(key), seed), key).limit(n)


def ranked(rows: DataFrame, by: Sequence[str], *order) -> DataFrame:
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def lowest(rows: DataFrame, by: Sequence[str], limits: DataFrame, key: str, seed: int, spread: float = 8.0) -> DataFrame:
    """Of each stratum the first _n rows in seeded order, exactly; limits is (by, _n, _of), _of the stratum's rows.

    Strata may be few and large, so no stratum is sorted: where the order's hash is clearly below the place where _n of _of
    rows should lie a row is taken, clearly above it is not, and only the rows in between are ranked, some square root of _n of them.
    Whether they lie there is counted; if not, what lies between is widened.
    """
    own = limits.select(*(F.col(c).alias(f"_by_{c}") for c in by), "_n", "_of")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    drawn = seeded_order(F.col(key), seed)
    unit = F.conv(F.substring(drawn, 1, 13), 16, 10).cast("double") / float(1 << 52)
    joined = rows.join(own, same).drop(*(f"_by_{c}" for c in by)).withColumn("_u", unit)
    while True:
        edge = spread * F.sqrt("_n") + 2 * spread
        below, upto = F.col("_u") < (F.col("_n") - edge) / F.col("_of"), F.col("_u") <= (F.col("_n") + edge) / F.col("_of")
        counts = written(joined.groupBy(*by).agg(F.sum(below.cast("long")).alias("_below"), F.sum(upto.cast("long")).alias("_upto"), F.first("_n").alias("_n"), F.first("_of").alias("_of")))
        if not counts.where((F.col("_below") > F.col("_n")) | (F.col("_upto") < F.least("_n", "_of"))).limit(1).count():
            break
        spread *= 4
    before = counts.select(*(F.col(c).alias(f"_by_{c}") for c in by), "_below")
    between = joined.where(~below & upto).join(before, same).withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(drawn, key)))
    ranked_ = between.where(F.col("_rank") + F.col("_below") <= F.col("_n"))
    return joined.where(below).select(rows.columns).union(ranked_.select(rows.columns))


def equal_shares(rows: DataFrame, stratum: str, key: str, size: int, seed: int, strata: int) -> DataFrame:
    """size // strata rows of each stratum; no rows at all where a stratum falls short."""
    share = size // strata
    counts = written(rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("_of")))
    if counts.where(F.col("_of") < share).limit(1).count():
        return rows.limit(0)
    return lowest(rows, [stratum], counts.withColumn("_n", F.lit(share).cast("long")), key, seed)


def quota(rows: DataFrame, cells: Sequence[str], dedupe: str, key: str, most: int, seed: int) -> DataFrame:
    """At most `most` rows of each cell, after keeping the first row of each dedupe key within it."""
    first = ranked(rows, [*cells, dedupe], key).where(F.col("_rank") == 1)
    first = written(first.drop("_rank"))
    limits = first.groupBy(*cells).agg(F.count(F.lit(1)).alias("_of")).withColumn("_n", F.lit(most).cast("long"))
    return lowest(first, cells, limits, key, seed)


def systematic(rows: DataFrame, index: Column, step: int) -> DataFrame:
    return rows.where(F.pmod(index, F.lit(step)) == 0)


def held_out(key: Column, modulus: int = 10) -> Column:
    return sha1_bucket(key, modulus) == 0


def sign_balance(rows: DataFrame, score: str, key: str, edges: Sequence[float], seed: int) -> DataFrame:
    """Per band of |score| the larger sign is thinned to the smaller; zeros stay and are in neither sign's pool."""
    from ..functions.scalars import bands

    banded = rows.withColumn("band", bands(F.abs(score), edges, [str(e) for e in edges[:-1]])).withColumn("sign", F.signum(score).cast("int"))
    counts = banded.where("sign <> 0").groupBy("band").agg(
        F.sum((F.col("sign") > 0).cast("long")).alias("plus"), F.sum((F.col("sign") < 0).cast("long")).alias("minus"))
    counts = written(counts)
    sides = [counts.select("band", F.lit(s).alias("sign"), F.least("plus", "minus").alias("_n"), F.col(n).alias("_of")) for s, n in ((1, "plus"), (-1, "minus"))]
    limits = sides[0].union(sides[1]).where("_of > 0")
    return banded.where("sign = 0").unionByName(lowest(banded.where("sign <> 0"), ["band", "sign"], limits, key, seed))


def first_of(rows: DataFrame, by: Sequence[str], *order) -> DataFrame:
    return ranked(rows, by, *order).where(F.col("_rank") == 1).drop("_rank")


def weighted_union(parts: Sequence[tuple[DataFrame, int]]) -> DataFrame:
    """UNION ALL in which each part is listed as often as its weight says."""
    out = None
    for df, weight in parts:
        copies = df.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(weight).cast("long"))))
        out = copies if out is None else out.unionByName(copies)
    return out


def last_of(rows: DataFrame, by: Sequence[str], order: Sequence[Column], seen: Column, name: str) -> DataFrame:
    """The last row of each key by the order, with the least `seen` of all its rows; sorted by that, as keys first came. Aggregates only, before the shuffle too."""
    rest = [c for c in rows.columns if c not in by]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    kept = rows.groupBy(*by).agg(F.min(seen).alias(name), last)
    return kept.select(*by, name, "_last.*").orderBy(name)


def quarantined(inputs: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """The inputs that the manifest quarantines, once each, with the number of its entries that name them (reasons)."""
    return inputs.select(key).distinct().join(manifest.groupBy(key).agg(F.count(F.lit(1)).alias("reasons")), key)


def refuse_quarantined(inputs: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """The inputs, or an error that counts all that the manifest quarantines and lists the first 1000."""
    found = inputs.join(manifest.select(key).distinct(), key, "left_semi").select(key).distinct()
    hits = [r[0] for r in found.orderBy(key).limit(1000).collect()]
    if hits:
        n = len(hits) if len(hits) < 1000 else found.count()
        raise ValueError(f"{n} quarantined inputs{', the first 1000' if n > 1000 else ''}: {hits}")
    return inputs
