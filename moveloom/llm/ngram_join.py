r"""Jaccard join on word n-grams by vertical partitioning (operator 1).

A document's set holds its distinct n-grams of lower-cased words. All n-grams have one global order: by the
number of sets that have them, rare ones first, then by hash.

1. Equal sets become one node. n-grams are first dealt by ranges of hashes: each goes to its range in
   packed arrays, and those that other sets have too are sent back. An n-gram of one set only can't overlap,
   so a set is dropped unless enough of it is shared; among the sets left this is counted once more, exactly,
   and gives the global order.
2. A node posts the n-grams of its prefix (so many of its first that two sets that link must share one).
   Within an n-gram, a node is paired with the most central node of another component, in its size class
   and in the class below: as many pairs as postings, however large a group is. This runs ROUNDS times.
3. Candidate pairs are counted exactly: the global order is cut into FRAGMENTS, each node's n-grams are
   cut with it, the overlap of a pair is counted in each fragment by itself, and the counts are summed per
   pair. The pair links if the sum reaches the threshold.
4. Links are contracted to components after each round. Then postings whose nodes all lie in one component
   have nothing left to say; in all others each pair across two components that may still link is counted
   as in 3, and components are contracted once more. So no link between different components is missed, and
   copies are never expanded into all their pairs. At an n-gram that more than OPEN_NODES
   such nodes post, a pair becomes a row only if the n-gram is the first that both post and what the prefixes
   share leaves a link possible.

An n-gram that several sets of one chunk have goes to its range once; the sets stay with the chunk. So what
a very common n-gram sends does not grow with its documents but with the chunks. A chunk sends a range one
row, if anything; where there are so many ranges that a row would hold one n-gram only, rows are as many as
n-grams and no more. Leaders and counts of an n-gram are aggregates, which tasks begin before the shuffle,
and joins, whose large keys can be split. n-grams and nodes are known by 64 bits of their hash.

Defined cases: a null or blank text has an empty set and stays alone; a text with fewer words than n has
one n-gram, its whole sequence; equal texts have equal sets and share a component; ids that occur on
several rows get a row each, null ids give way to others in a component; an empty table gives an empty
table. Whole texts are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import Scratch, free_shuffles

N = 4
PERCENT = 85
FRAGMENTS = 8
#: Turns in which nodes are paired with leaders only, before pairs across components are all tried.
ROUNDS = 2
#: Words whose hashes a worker remembers before it starts anew.
WORD_MEMORY = 200_000
#: n-grams of a chunk of sets, sets of a chunk, and documents per hash range.
CHUNK_GRAMS = 600_000
CHUNK_SETS = 60_000
RANGE_DOCS = 2_500
#: Parts of the components among which the two nodes that lead an n-gram are found.
LEADER_PARTS = 16
#: Nodes that may post an open n-gram before its pairs are held against what their prefixes share.
OPEN_NODES = 16
NO_ID = -(1 << 63)
_P = np.uint64(0x9DDFEA08EB382D69)


class Words(dict):
    """Hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORD_MEMORY:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _P
    h = (h ^ (h >> np.uint64(29))) * _P
    return h ^ (h >> np.uint64(32))


class Shingler:
    def __init__(self, n: int):
        self.n, self.words = n, Words()

    def hashes(self, text: str | None) -> np.ndarray:
        """Distinct n-gram hashes of a text, ascending. bytes.lower() and split() know ASCII only, as the contract does."""
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else ()
        m = len(words)
        if not m:
            return np.zeros(0, np.uint64)
        known = self.words
        h = np.fromiter((known[w] for w in words), np.uint64, m)
        width = min(self.n, m)
        out = np.full(m - width + 1, width, np.uint64)
        for k in range(width):
            out = (out + h[k : m - width + 1 + k]) * _P
            out ^= out >> np.uint64(31)
        return np.unique(_mixed(out))


def node_of(hashes: np.ndarray) -> int:
    """The set's name, as a signed 64-bit number."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).astype(np.int64))


def _ranges_of(grams: np.ndarray, ranges: int) -> np.ndarray:
    return ((grams >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


_POSTED = "range int, chunk string, kind int, grams binary, place binary, ids binary"


def _posted(docs: DataFrame, n: int, ranges: int) -> DataFrame:
    """Packed n-grams with the numbers of their sets in the chunk.

    Kind 1: n-grams of one set of the chunk, by range. Kind 2: one mention each of those of several sets, by
    range. Kind 0, once per chunk: its sets (node, size), its documents (id, number of the set), and the
    n-grams of several sets with those sets.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        shingler, task, number = Shingler(n), TaskContext.get().partitionId(), 0
        nodes: dict[int, int] = {}
        held: list[np.ndarray] = []
        ids: list[tuple[int, int]] = []
        size = 0

        def flush():
            nonlocal nodes, held, ids, size, number
            chunk, rows = f"{task}-{number}", []
            grams = np.concatenate(held)
            sets = np.repeat(np.arange(len(held)), [len(h) for h in held])
            order = np.argsort(grams, kind="stable")  # ranges of hashes are ranges of this order
            grams, sets = grams[order], sets[order]
            equal = grams[1:] == grams[:-1]
            again = np.zeros(len(grams), bool)
            again[1:] = equal
            several = again.copy()
            several[:-1] |= equal
            for kind, some in ((1, ~several), (2, several & ~again)):
                own, own_sets = grams[some], sets[some]
                at = _ranges_of(own, ranges)
                cuts = np.searchsorted(at, np.arange(ranges + 1))
                for r in np.flatnonzero(np.diff(cuts)):
                    part = slice(cuts[r], cuts[r + 1])
                    rows.append((int(r), kind, _packed(own[part]), own_sets[part].astype(np.uint16).tobytes() if kind == 1 else b"", b""))
            table = np.stack([np.array(list(nodes), np.int64), np.array([len(h) for h in held], np.int64)]).tobytes()
            rows.append(((task * 31 + number) * 7919 % ranges, 0, _packed(grams[several]), sets[several].astype(np.uint16).tobytes(), len(held).to_bytes(8, "little") + table + np.array(ids, np.int64).tobytes()))
            nodes, held, ids, size, number = {}, [], [], 0, number + 1
            r, k, *parts = zip(*rows, strict=True)
            columns = [pa.array(r, pa.int32()), pa.array([chunk] * len(r)), pa.array(k, pa.int32()), *(pa.array(x, pa.binary()) for x in parts)]
            return pa.RecordBatch.from_arrays(columns, names=["range", "chunk", "kind", "grams", "place", "ids"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = shingler.hashes(text.as_py())
                node = node_of(h)
                if node not in nodes:
                    nodes[node] = len(nodes)
                    held.append(h)
                    size += len(h)
                ids.append((NO_ID if doc is None else doc, nodes[node]))
                if size >= CHUNK_GRAMS or len(nodes) >= CHUNK_SETS or len(ids) >= 4 * CHUNK_SETS:
                    yield flush()
        if held:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _POSTED)


def _packed(grams: np.ndarray) -> bytes:
    """Ascending numbers: a byte for the width of steps, the first one, and steps of 48 bits (their lower 32, then their
    upper 16), where a step of all ones adds its value and goes on; or of 64 bits where too many are longer."""
    if not len(grams):
        return b""
    most = np.uint64((1 << 48) - 1)
    steps = np.diff(grams)
    more = (steps // most).astype(np.int64)
    if 8 * more.sum() > len(steps):
        return b"\x08" + grams[:1].tobytes() + steps.tobytes()
    out = np.full(len(steps) + int(more.sum()), most, np.uint64)
    out[np.cumsum(more + 1) - 1] = steps % most
    return b"\x06" + grams[:1].tobytes() + out.astype(np.uint32).tobytes() + (out >> np.uint64(32)).astype(np.uint16).tobytes()


def _grams(packed: bytes) -> np.ndarray:
    if not packed:
        return np.zeros(0, np.uint64)
    first, n = np.frombuffer(packed, np.uint64, 1, 1), (len(packed) - 9) // packed[0]
    if packed[0] == 8:
        return np.cumsum(np.concatenate([first, np.frombuffer(packed, np.uint64, n, 9)]), dtype=np.uint64)
    steps = np.frombuffer(packed, np.uint32, n, 9).astype(np.uint64) | np.frombuffer(packed, np.uint16, n, 9 + 4 * n).astype(np.uint64) << np.uint64(32)
    done = np.cumsum(steps, dtype=np.uint64)[steps != np.uint64((1 << 48) - 1)]
    return np.concatenate([first, first + done])


def _shared(pdf):
    """Of one range: n-grams of kind 1 that another set has too, by chunk; rows of kind 0 pass."""
    import pandas as pd

    passed = pdf[pdf.kind == 0].drop(columns="range")
    rows = pdf[pdf.kind > 0]
    if not len(rows):
        return passed.astype({"chunk": object})
    parts = [_grams(x) for x in rows.grams]
    everything = np.concatenate(parts)
    order = np.argsort(everything, kind="stable")
    equal = everything[order[1:]] == everything[order[:-1]]
    twice = np.zeros(len(everything), bool)
    twice[order[1:]] = equal
    twice[order[:-1]] |= equal
    out, at = [], 0
    for chunk, kind, place, part in zip(rows.chunk, rows.kind, rows.place, parts, strict=True):
        flags = twice[at : at + len(part)]
        at += len(part)
        if kind == 1 and flags.any():
            out.append((chunk, 1, _packed(part[flags]), np.frombuffer(place, np.uint16)[flags].tobytes(), b""))
    return pd.concat([passed, pd.DataFrame(out, columns=list(passed.columns))]).astype({"chunk": object})


def _sets_of(percent: int):
    """Of one chunk: its documents (doc_id, node, size), and the sets enough of which is shared (node, size, grams)."""

    def run(pdf):
        import pandas as pd

        table = pdf[pdf.kind == 0].iloc[0]
        count = int.from_bytes(table["ids"][:8], "little")
        node, size = np.frombuffer(table["ids"], np.int64, 2 * count, 8).reshape(2, -1)
        ids, own = np.frombuffer(table["ids"], np.int64, -1, 8 + 16 * count).reshape(-1, 2).T
        docs = pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "node": node[own], "size": size[own], "grams": None})
        docs.loc[ids == NO_ID, "doc_id"] = pd.NA
        grams = np.concatenate([_grams(x) for x in pdf.grams]).astype(np.int64)
        sets = np.concatenate([np.frombuffer(x, np.uint16) for x in pdf.place])
        order = np.argsort(sets, kind="stable")
        cuts = np.searchsorted(sets[order], np.arange(count + 1))
        enough = np.flatnonzero((100 * np.diff(cuts) >= percent * size) & (size > 0))
        found = pd.DataFrame({"doc_id": pd.array([pd.NA] * len(enough), "Int64"), "node": node[enough], "size": size[enough], "grams": [grams[order[cuts[i] : cuts[i + 1]]] for i in enough]})
        return pd.concat([docs, found])

    return run


def _verified(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b, size_a, size_b) -> those that link, by overlaps counted per fragment and summed."""
    wanted = sets.join(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "node", "left_semi")
    single = wanted.select("node", "order", "cuts", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))).alias("fragment"))
    begin, end = F.get("cuts", F.col("fragment")), F.get("cuts", F.col("fragment") + 1)
    parts = single.where(end > begin).select("node", "fragment", F.slice("order", begin + 1, end - begin).alias("grams"))
    left = pairs.join(parts.select(F.col("node").alias("a"), "fragment", F.col("grams").alias("grams_a")), "a")  # pairs as they are: a table eight times its files would be broadcast
    both = left.join(parts.select(F.col("node").alias("b"), "fragment", F.col("grams").alias("grams_b")), ["b", "fragment"])
    partial = both.select("a", "b", "size_a", "size_b", F.size(F.array_intersect("grams_a", "grams_b")).alias("part"))
    summed = partial.groupBy("a", "b", "size_a", "size_b").agg(F.sum("part").alias("overlap"))
    return summed.where(100 * F.col("overlap") >= percent * (F.col("size_a") + F.col("size_b") - F.col("overlap"))).select("a", "b")


def _possible(percent: int):
    """Sizes fit, and what follows the shared n-gram in both orders is enough for the threshold.

    Nothing before a pair's first shared n-gram is shared, so a pair that links passes there; rows of
    later n-grams are judged more strictly still, which loses no pair.
    """
    fits = 100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b")
    rest = F.least(F.col("size_a") - F.col("pos_a"), F.col("size_b") - F.col("pos_b"))
    return fits & ((100 + percent) * rest >= percent * (F.col("size_a") + F.col("size_b"))) & (F.col("a") != F.col("b"))


def _led(scratch: Scratch, posted: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of each node with the most central node of another component, in its class and the one below, per n-gram."""
    named = posted.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # the best node of each part of the components, then the best two of these few: both steps begin before the shuffle
    best = named.groupBy("gram", "class", F.pmod(F.xxhash64("component"), F.lit(LEADER_PARTS))).agg(F.max(F.struct("score", "node", "size", "pos", "component")).alias("lead"))
    leaders = best.groupBy("gram", "class").agg(F.sort_array(F.collect_list("lead"), asc=False).alias("leads"))
    leaders = scratch.keep(leaders.select("gram", "class", F.get("leads", F.lit(0)).alias("first"), F.get("leads", F.lit(1)).alias("second")))
    pairs = None
    for above in (0, 1):
        by_class = leaders.withColumn("class", F.col("class") + above)
        met = named.join(by_class, ["gram", "class"])
        b = F.when(F.col("component") != F.col("first.component"), F.col("first")).otherwise(F.col("second"))
        met = met.select(F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("pos").alias("pos_a"), b.alias("b")).where("b is not null")
        met = met.select("a", "size_a", "pos_a", F.col("b.node").alias("b"), F.col("b.size").alias("size_b"), F.col("b.pos").alias("pos_b")).where(_possible(percent))
        pairs = met if pairs is None else pairs.union(met)
    return pairs.select(*_sorted_pair()).distinct()


def _sorted_pair() -> list:
    """a, b, size_a, size_b with the smaller node first."""
    turn = F.col("a") > F.col("b")
    return [F.when(turn, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("size_a", "size_b"), ("size_b", "size_a"))]


def _across(scratch: Scratch, posted: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """All pairs of nodes of different components that share a posted n-gram and may link.

    An n-gram is open if nodes of several components post it, as do the two of each pair wanted. At one that more than OPEN_NODES
    nodes post, a pair becomes a row only if it is their first one in common and what they share in their prefixes and the
    longer of their rests are enough; most of what sets differ in lies in the prefixes, so few pairs that do not link pass.
    Nodes of the component that posts an n-gram most often are never held against one another.
    """
    named = posted.select("gram", "node", "size", "pos").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    shares = named.groupBy("gram", "component").agg(F.count(F.lit(1)).alias("n"))
    several = shares.groupBy("gram").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("nodes"), F.count(F.lit(1)).alias("n")).where("n > 1")
    found = scratch.keep(named.join(scratch.keep(several.select("gram", F.col("main.component").alias("main"), "nodes")), "gram"))  # a join of two tables, whose large keys can be split
    rows = found.withColumn("is_main", F.col("component") == F.col("main"))

    def met(rows: DataFrame, more: list[str], enough: Column) -> DataFrame:
        x, y = (rows.select("gram", "is_main", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "size", "pos", "component", *more))) for s in "ab")
        x = x.where("not is_main").drop("is_main").withColumn("a", F.col("node_a"))
        y = y.withColumn("b", F.col("node_b"))
        other = (F.col("component_a") != F.col("component_b")) & (F.col("is_main") | (F.col("node_a") < F.col("node_b")))
        return x.join(y.withColumnRenamed("gram", "gram_b"), (F.col("gram") == F.col("gram_b")) & other & _possible(percent) & enough).select(*_sorted_pair())

    pairs = met(rows.where(F.col("nodes") <= OPEN_NODES), [], F.lit(True))
    many = rows.where(F.col("nodes") > OPEN_NODES)
    if many.limit(1).count():
        listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "gram"))), lambda x: x["gram"])
        posts = found.groupBy("node").agg(listed.alias("open"), F.max("nodes").alias("most")).where(F.col("most") > OPEN_NODES)
        pairs = pairs.union(met(scratch.keep(many.join(posts.select("node", "open"), "node")), ["open"], _enough(percent)))
    return pairs.distinct()


def _enough(percent: int) -> Column:
    """The n-gram is the first that both prefixes have, and these have enough in common: of what a pair shares, all before the end of the
    prefix that ends first is in both prefixes, and the rest is behind that prefix in its set."""
    both = F.array_intersect("open_a", "open_b")
    behind = F.greatest(*(F.ceil(F.lit(percent) * F.col(s) / F.lit(100.0)) - 1 for s in ("size_a", "size_b")))
    return (F.get(both, F.lit(0)) == F.col("gram")) & ((100 + percent) * (F.size(both) + behind) >= percent * (F.col("size_a") + F.col("size_b")))


def _prefix(percent: int) -> Column:
    """How many of a set's n-grams of several sets are in its prefix; n-grams of one set stand first in the order and are passed over."""
    return (F.col("size") - F.ceil(F.lit(percent) * F.col("size") / F.lit(100.0)) + 1 - (F.col("size") - F.size("order"))).cast("int")


def _counted(scratch: Scratch, found: DataFrame, percent: int) -> DataFrame:
    """Sets (node, size, order, cuts): n-grams of two sets or more in the global order, and where its fragments begin; sets with enough of them.

    found, which has the sets of all chunks beside other rows, is deleted.
    """
    sets = found.where("grams is not null")
    once = scratch.keep(sets.groupBy("node").agg(F.first("size").alias("size"), F.first("grams").alias("grams")))
    scratch.drop(found)
    free_shuffles(scratch.spark)
    single = once.select("node", F.explode("grams").alias("gram"))
    counts = scratch.keep(single.groupBy("gram").agg(F.count(F.lit(1)).cast("int").alias("n_sets")).where("n_sets > 1"))
    free_shuffles(scratch.spark)
    # the place in the order as a number; n-grams too near to be told apart are in one fragment
    place = F.col("n_sets") + (F.col("gram") / float(1 << 64) + 0.5)
    bounds = counts.agg(F.percentile_approx(place, [k / FRAGMENTS for k in range(1, FRAGMENTS)], 1000).alias("b")).first().b or []
    again = single.join(counts, "gram").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n_sets", "gram"))).alias("order"))
    again = again.join(once.select("node", "size"), "node").where(100 * F.size("order") >= percent * F.col("size"))
    below = lambda bound: F.size(F.filter("order", lambda x: x["n_sets"] + (x["gram"] / float(1 << 64) + 0.5) < bound))
    before = [below(b) for b in bounds]
    cuts = F.array(F.lit(0), *before, *[F.size("order")] * (FRAGMENTS - len(before)))
    out = scratch.keep(again.select("node", "size", F.transform("order", lambda x: x["gram"]).alias("order"), cuts.alias("cuts")))
    scratch.drop(counts)
    scratch.drop(once)
    free_shuffles(scratch.spark)
    return out


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(gram, pos, node, size, class, score) of each set's prefix."""
    alone = F.col("size") - F.size("order")
    kind = F.floor(F.log(F.col("size").cast("double")) / -math.log(percent / 100) + 1e-9).cast("int")
    score = F.size("order") / F.col("size")  # a set most of which is shared lies in the middle of its group
    taken = sets.where(_prefix(percent) > 0).select("node", "size", kind.alias("class"), score.alias("score"), alone.alias("alone"), F.posexplode(F.slice("order", F.lit(1), _prefix(percent))).alias("at", "gram"))
    return taken.select("gram", (F.col("alone") + F.col("at")).cast("int").alias("pos"), "node", "size", "class", "score")


def join_classes(spark: SparkSession, docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id, one row per row of docs."""
    docs = docs.select("doc_id", "text")
    scratch = Scratch(spark)
    ranges = int(max(16, docs.count() // RANGE_DOCS))
    back = _posted(docs, n, ranges).groupBy("range").applyInPandas(_shared, _POSTED.replace("range int, ", ""))
    found = scratch.keep(back.groupBy("chunk").applyInPandas(_sets_of(percent), "doc_id long, node long, size long, grams array<long>"))
    del back
    free_shuffles(spark)
    rows = scratch.keep(found.where("grams is null").select("doc_id", "node", F.col("size").alias("n_shingles")))
    sets = _counted(scratch, found, percent)
    posted = scratch.keep(_prefixes(sets, percent))

    labels = spark.createDataFrame([], "node long, component long")
    links = tried = None
    for turn in range(ROUNDS + 1):
        pairs = _led(scratch, posted, labels, percent) if turn < ROUNDS else _across(scratch, posted, labels, percent)
        pairs = scratch.keep(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        if not pairs.limit(1).count():
            continue
        found = scratch.keep(_verified(sets, pairs, percent))
        if links is not None and not found.limit(1).count():
            tried = tried.union(pairs.select("a", "b"))
            continue
        links = found if links is None else links.union(found)
        tried = pairs.select("a", "b") if tried is None else tried.union(pairs.select("a", "b"))
        labels = scratch.keep(components(scratch, links.select(F.col("a").alias("u"), F.col("b").alias("v"))))

    smallest = rows.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least_doc"))
    named = smallest.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = named.groupBy("component").agg(F.min("least_doc").alias("component_id"))
    per_node = named.join(ids, "component").select("node", "component_id")
    out = rows.join(per_node, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
