"""Mixing sources to target weights (operator 10), in DataFrame functions only.

Tokens are summed per source, target sizes follow from the weights, and a source's repetition rate
is its target over its size. Every document is then emitted floor(rate) times plus one copy more
with probability equal to the rate's fraction, decided by a hash of its id, its text and the seed. The hash is not
compared with the fraction itself, which would leave a source of few documents far from its target, but by its place:
a document has the copy if the words before it in hash order, and half its own, are at most that fraction of its source's
words. So each source misses its target by half a document at most. A source's last such document is all that others have
to be compared with; whole documents are never sorted.

Defined cases: a null text has size 0; a null source is a source of its own, the last in order; rows equal in id, text
and source stand side by side in hash order, and where the fraction ends among them, some have the copy (where they
differ in other columns, which of them depends on how the table is laid out); unlike texts under one id or none are
decided each by itself; an empty table gives an empty table; a source whose
documents are all empty has target 0; other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, fresh, prefix_sums, with_group, word_count

WEIGHTS = (1.0, 2.0, 3.0)
MAX_REPEAT = 3.0
SEED = 20


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """(source, size) -> (source, source_size, size_before, target), written down; size_before sums the sources before it in order.

    Weights go to the sources by code point, repeating, null last. All sizes together are shared by
    weight; no target exceeds max_repeat times its source's size, and what is cut off there is shared
    again by weight. That fixed point is found in one pass: with sources ordered by cap per weight,
    the capped ones are a prefix, and what the rest share is what the prefix leaves over. Both orders
    are sorted in ranges; of the sources only two numbers reach the driver.
    """
    scratch = Scratch(sizes.sparkSession)
    by_source = scratch.keep(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    name = [F.col("source").isNull().asc(), F.col("source").asc()]
    numbered = prefix_sums(scratch, by_source, name, {"number": F.lit(1).cast("long"), "size_before": F.col("source_size")})
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("number") % len(weights) + 1).cast("int"))
    caps = numbered.withColumn("weight", weight).drop("number").withColumn("cap", F.col("source_size") * float(max_repeat))
    caps = caps.withColumn("per_weight", F.col("cap") / F.col("weight"))
    summed = prefix_sums(scratch, caps, [F.col("per_weight").asc(), *name], {"capped_before": F.col("cap"), "weight_before": F.col("weight")})
    all_ = caps.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("weight")).first()
    level = (F.lit(all_.total) - F.col("capped_before")) / (F.lit(all_.weight) - F.col("weight_before"))
    water = summed.withColumn("level", level).where("per_weight > level").agg(F.min(F.struct("per_weight", "level")).alias("least")).first().least
    target = F.least(F.col("cap"), F.col("weight") * water.level) if water else F.col("cap")
    return scratch.keep(caps.select("source", "source_size", "size_before", target.alias("target")))


def drawing_key(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """The hash whose order decides about copies."""
    parts = (F.coalesce(c.cast("string"), F.lit("")) for c in (doc_id, text))
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def source_plan(rows: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """(source, size, key) -> source, source_size, target, whole, cut, with_copy, of; a row per source, written down.

    Documents of the source are taken `whole` times, those with a key before `cut` once more, and so are `with_copy` of
    the `of` documents whose key it is.
    """
    scratch = Scratch(rows.sparkSession)
    targets = source_targets(rows.select("source", "size"), weights, max_repeat)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_repeat)))).otherwise(0.0)
    targets = scratch.keep(targets.withColumn("rate", rate).withColumn("share", (F.col("rate") - F.floor("rate")) * F.col("source_size")))
    alike = rows.groupBy("source", "key").agg(F.count(F.lit(1)).alias("of"), F.max("size").alias("size"))
    order = [F.col("source").isNull().asc(), F.col("source").asc(), F.col("key").asc()]
    summed = prefix_sums(scratch, alike, order, {"before": F.col("of") * F.col("size")})
    groups = targets.select(F.col("source").alias("_source"), "share", "size_before")
    placed = with_group(summed, groups, "source", "_source").withColumn("before", F.col("before") - F.col("size_before"))
    one = (F.col("before") + 0.5 * F.col("size") <= F.col("share")).cast("long")
    some = F.greatest(F.lit(0), F.least(F.col("of"), F.floor((F.col("share") - F.col("before")) / F.col("size") + 0.5)))
    taken = F.when(F.col("of") == 1, one).when(F.col("size") == 0, one * F.col("of")).otherwise(some)
    cuts = placed.withColumn("with_copy", taken).where("with_copy > 0").groupBy("source").agg(F.max(F.struct("key", "with_copy", "of")).alias("cut"))
    same = F.col("source").eqNullSafe(F.col("_source"))
    cuts = cuts.select(F.col("source").alias("_source"), F.col("cut.key").alias("cut"), "cut.with_copy", "cut.of")
    return scratch.keep(targets.join(cuts, same, "left").select("source", "source_size", "target", F.floor("rate").alias("whole"), "cut", "with_copy", "of"))


def with_copies(rows: DataFrame, plan: DataFrame, source: str, key: str, names: Sequence[str]) -> DataFrame:
    """rows with source_size, target and copies, under these names."""
    size, target, copies = names
    held = {c: fresh(rows, f"_plan_{c}") for c in ("source", "whole", "cut", "with_copy", "of")}
    groups = plan.select(F.col("source").alias(held["source"]), F.col("source_size").alias(size), F.col("target").alias(target), *(F.col(c).alias(held[c]) for c in ("whole", "cut", "with_copy", "of")))
    joined = with_group(rows, groups, source, held["source"])
    whole, cut, some, of = (F.col(held[c]) for c in ("whole", "cut", "with_copy", "of"))
    split = F.coalesce((F.col(key) == cut) & (some < of), F.lit(False))
    once = F.coalesce(F.col(key) <= cut, F.lit(False)) & ~split
    out = joined.withColumn(copies, (whole + once.cast("long")).cast("long"))
    if plan.where("with_copy < of").limit(1).count():
        # equal rows, some of which have the copy: numbered in ranges, without a window over them
        scratch, number = Scratch(rows.sparkSession), fresh(out, "_number")
        tied = prefix_sums(scratch, scratch.keep(out.where(split)), [F.col(key)], {number: F.lit(1).cast("long")})
        tied = scratch.keep(tied)
        firsts = scratch.keep(tied.groupBy(F.col(key).alias(f"{number}_key")).agg(F.min(number).alias(f"{number}_first")))
        tied = with_group(tied, firsts, key, f"{number}_key")
        drawn = (F.col(number) - F.col(f"{number}_first") < some).cast("long")
        out = out.where(~split).unionByName(tied.withColumn(copies, F.col(copies) + drawn).select(out.columns))
    return out.drop(*held.values())


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeat: float = MAX_REPEAT, seed: int = SEED,
                text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The mix itself: each document as often as the plan says, with the columns of docs."""
    own = drawing_key(F.col(doc_id), F.col(text), seed)
    plan = source_plan(Scratch(docs.sparkSession).keep(docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size"), own.alias("key"))), weights, max_repeat)
    key = fresh(docs, "_key")
    names = [fresh(docs, n) for n in ("source_size", "target", "copies")]
    planned = with_copies(docs.withColumn(key, own), plan, source, key, names)
    copies, turn = names[-1], fresh(docs, "_turn")
    repeated = planned.where(F.col(copies) > 0).withColumn(turn, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
    return repeated.select(*docs.columns)


def mix_digest(docs: DataFrame) -> DataFrame:
    measured = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), drawing_key(F.col("doc_id"), F.col("text")).alias("key"))
    measured = Scratch(docs.sparkSession).keep(measured)
    planned = with_copies(measured, source_plan(measured), "source", "key", ["source_size", "target", "copies"])
    return planned.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
