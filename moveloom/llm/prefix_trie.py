"""Prefix trie of conversations by preorder intervals (operator 13).

A node is a distinct sequence of first turns; its subtree are the nodes that begin with it.

1. Turns are numbered within their conversation by one sort in ranges, and each prefix is known by its length and a
   sum over its turns of a number drawn from (turn, place), a distributed prefix sum as well. No conversation is
   gathered in one task, however long.
2. Distinct whole sequences are ranked lexicographically. A sequence longer than BLOCK turns is first cut into blocks
   of that many; distinct blocks are sorted and named by their rank, which keeps the order of sequences, and names
   take the place of turns, as often as it takes until BLOCK names are enough.
3. A node's conversations have neighbouring ranks, and the node belongs to the smallest. So (smallest rank, depth) is
   preorder: a node stands before all of its subtree, which ends before the first node whose smallest rank exceeds the
   node's largest. Begin and end are what is stored of the subtree.
4. Leaves and saved tokens of a subtree are differences of distributed prefix sums at end and begin.
5. Ids of conversations that end at a node are joined in pieces of PIECE sorted ids by aggregates; a node's pieces are
   then fed to SHA-256 one after the other. That hash has to read its input in order, so one task reads the pieces of
   one node, a row per PIECE ids, and holds one at a time.

Prefixes of equal length are taken for equal when 86 bits of their sums are, turns when their MD5 sums are.

Defined cases: null roles and texts are empty; rows without a conversation id belong to none and are passed over; turns of
one number come by role, then by MD5 of the turn, null numbers first; repeated rows are turns of their own; long texts
count whole; no conversations make no nodes, not even a root; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, prefix_sums, word_count

#: Turns, or names of blocks of turns, in one row.
BLOCK = 64
#: Conversation ids joined in one row.
PIECE = 4096
_EMPTY = hashlib.sha256(b"").hexdigest()
_SUM = "decimal(38,0)"


def numbered_turns(scratch: Scratch, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, at, key, words) per turn, at from 0; (conv_id, n) per conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), key.alias("key"), word_count(text).alias("words"))
    order = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("key").asc()]
    rows = prefix_sums(scratch, turns, order, {"number": F.lit(1).cast("long")})
    rows = scratch.keep(rows.select("conv_id", "number", "key", "words"))
    convs = scratch.keep(rows.groupBy("conv_id").agg(F.min("number").alias("start"), F.count(F.lit(1)).alias("n")))
    own = rows.join(convs, "conv_id").select("conv_id", (F.col("number") - F.col("start")).alias("at"), "key", "words")
    return scratch.keep(own), convs.select("conv_id", "n")


def spliced(turns: DataFrame, convs: DataFrame, block: Column, heads: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Each conversation with its first `heads` (at most `most`) turns replaced by as many of conversation `block`, or what that has.

    Returned as numbered_turns() returns them.
    """
    planned = convs.select("conv_id", "n", block.alias("block"), heads.cast("long").alias("heads"))
    lengths = convs.select(F.col("conv_id").alias("block"), F.col("n").alias("block_n"))
    planned = planned.join(lengths, "block", "left").withColumn("lead", F.least("heads", F.coalesce("block_n", F.lit(0).cast("long"))))
    fronts = turns.where(F.col("at") < most).withColumnRenamed("conv_id", "block")
    front = planned.select("conv_id", "block", "lead").join(fronts, "block").where("at < lead").select("conv_id", "at", "key", "words")
    rest = turns.join(planned.select("conv_id", "heads", "lead"), "conv_id").where("at >= heads").select("conv_id", (F.col("at") - F.col("heads") + F.col("lead")).alias("at"), "key", "words")
    members = planned.select("conv_id", (F.col("lead") + F.greatest(F.col("n") - F.col("heads"), F.lit(0))).alias("n"))
    return front.union(rest), members


def _mark() -> Column:
    """86 bits drawn from a turn and its place."""
    bits = lambda seed: F.shiftrightunsigned(F.xxhash64(F.lit(seed), "key", "at"), 21).cast(_SUM)
    return (bits(1) * F.lit(1 << 43).cast("decimal(14,0)") + bits(2)).cast(_SUM)


def prefixes(scratch: Scratch, turns: DataFrame) -> DataFrame:
    """(conv_id, depth, key, words, node, parent): each turn with the sums of the prefix that ends with it and of the one before."""
    summed = prefix_sums(scratch, turns.withColumn("mark", _mark()), [F.col("conv_id"), F.col("at")], {"before": F.col("mark")})
    summed = scratch.keep(summed)
    starts = summed.where("at = 0").select("conv_id", F.col("before").alias("start"))
    parent = (F.col("before") - F.col("start")).cast(_SUM)
    out = summed.join(starts, "conv_id").select("conv_id", (F.col("at") + 1).alias("depth"), "key", "words", (parent + F.col("mark")).cast(_SUM).alias("node"), parent.alias("parent"))
    return scratch.keep(out)


def _gathered(rows: DataFrame, *by: Column) -> DataFrame:
    """The keys of each group, BLOCK at most, in order."""
    listed = F.array_sort(F.collect_list(F.struct("at", "key")))
    return rows.groupBy(*by).agg(F.transform(listed, lambda x: x["key"]).alias("names"))


def ranked(scratch: Scratch, paths: DataFrame, rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """paths (path) and their turns (path, at, key) -> (path, rank) by lexicographic order of keys; equal sequences must be one path."""
    while (rows.agg(F.max("at").alias("most")).first().most or 0) >= block:
        blocks = scratch.keep(_gathered(rows, "path", F.expr(f"at div {block}").alias("at")))
        names = prefix_sums(scratch, blocks.select("names").distinct(), [F.col("names")], {"key": F.lit(1).cast("long")})
        rows = scratch.keep(blocks.join(scratch.keep(names), "names").select("path", "at", "key"))
    wholes = paths.join(_gathered(rows, "path"), "path", "left")
    empty = F.array().cast(wholes.schema["names"].dataType)
    wholes = wholes.select("path", F.coalesce("names", empty).alias("names"))
    return scratch.keep(prefix_sums(scratch, wholes, [F.col("names")], {"rank": F.lit(1).cast("long")}).select("path", "rank"))


def _end_hashes(scratch: Scratch, ends: DataFrame) -> DataFrame:
    """(conv_id, depth, node) -> (depth, node, ends_sha256): SHA-256 of the node's ids, ascending, between commas."""
    order = [F.col("depth"), F.col("node"), F.col("conv_id")]
    numbered = prefix_sums(scratch, ends, order, {"number": F.lit(1).cast("long")})
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    pieces = numbered.groupBy("depth", "node", F.expr(f"number div {PIECE}").alias("piece")).agg(ids.alias("ids"))
    dealt = pieces.repartition("depth", "node").sortWithinPartitions("depth", "node", "piece")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        last = state = None
        out: list[tuple] = []

        def batch_of(rows):
            depth, node, digest = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(depth, pa.int64()), pa.array(node, pa.decimal128(38, 0)), pa.array(digest)], names=["depth", "node", "ends_sha256"])

        for batch in batches:
            for depth, node, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "node", "ids")), strict=True):
                if (depth, node) == last:
                    state.update(b"," + ids.encode())
                    continue
                if last is not None:
                    out.append((*last, state.hexdigest()))
                last, state = (depth, node), hashlib.sha256(ids.encode())
            if len(out) >= 1000:
                yield batch_of(out)
                out = []
        if last is not None:
            yield batch_of([*out, (*last, state.hexdigest())])

    return dealt.select("depth", "node", "ids").mapInArrow(run, f"depth long, node {_SUM}, ends_sha256 string")


def build_trie(scratch: Scratch, turns: DataFrame, members: DataFrame, block: int = BLOCK) -> DataFrame:
    """Turns and members as numbered_turns() gives them -> a row per node.

    begin and end are its interval in preorder; (conv_id, depth) names its last turn as that conversation's.
    """
    places = prefixes(scratch, turns)
    zero = F.lit(0).cast(_SUM)
    last = members.join(places.select("conv_id", F.col("depth").alias("n"), "node"), ["conv_id", "n"], "left")
    ends = scratch.keep(last.select("conv_id", F.col("n").alias("depth"), F.coalesce("node", zero).alias("node")))
    paths = scratch.keep(ends.groupBy("depth", "node").agg(F.min("conv_id").alias("path")))
    own = places.join(paths.select(F.col("path").alias("conv_id")), "conv_id", "left_semi").select(F.col("conv_id").alias("path"), (F.col("depth") - 1).alias("at"), "key")
    ranks = ranked(scratch, paths.select("path"), own, block)
    by_end = scratch.keep(paths.join(ranks, "path").select("depth", "node", "rank"))
    member_ranks = scratch.keep(ends.join(by_end, ["depth", "node"]).select("conv_id", "rank"))

    stats = [F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("rank").alias("first_rank"), F.max("rank").alias("last_rank"), F.max("words").alias("words"), F.max("parent").alias("parent")]
    inner = scratch.keep(places.drop("key").join(member_ranks, "conv_id")).groupBy("depth", "node").agg(*stats)
    top = member_ranks.select("*", F.lit(0).cast("long").alias("words"), F.lit(None).cast(_SUM).alias("parent")).agg(*stats).where("n_convs > 0")
    top = top.select(F.lit(0).cast("long").alias("depth"), zero.alias("node"), *top.columns)
    nodes = scratch.keep(inner.union(top.select(inner.columns)))

    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    counted = nodes.join(children, ["depth", "node"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    counted = scratch.keep(scratch.keep(counted).join(above, ["depth", "parent"], "left"))

    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("words")
    order = [F.col("first_rank"), F.col("depth")]
    placed = scratch.keep(prefix_sums(scratch, counted, order, {"begin": F.lit(1).cast("long"), "leaves_before": leaf, "saved_before": saved}))
    # sums up to and with the last node that a rank brings; none of them falls
    ended = placed.groupBy(F.col("first_rank").alias("last_rank")).agg(F.max(F.col("begin") + 1).alias("end"), F.max(F.col("leaves_before") + leaf).alias("leaves_after"), F.max(F.col("saved_before") + saved).alias("saved_after"))
    whole = scratch.keep(placed.join(ended, "last_rank"))
    shown = whole.join(_end_hashes(scratch, ends), ["depth", "node"], "left")
    return shown.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaves_after") - F.col("leaves_before")).alias("n_leaves"),
                        (F.col("saved_after") - F.col("saved_before")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"), "begin", "end")


def conversation_trie(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they are."""
    scratch = Scratch(spark)
    return build_trie(scratch, *numbered_turns(scratch, conversations))


def trie_digest(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The trie of conversations that begin as the one whose id is the next lower multiple of 20, by up to three turns."""
    scratch = Scratch(spark)
    turns, convs = numbered_turns(scratch, conversations)
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    rebuilt, members = spliced(turns, convs, F.col("conv_id") - F.col("conv_id") % 20, heads, 3)
    return build_trie(scratch, scratch.keep(rebuilt), scratch.keep(members)).drop("begin", "end")
