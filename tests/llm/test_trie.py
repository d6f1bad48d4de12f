"""The prefix trie of conversations against a plain one."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from moveloom.llm import prefix_trie
from moveloom.llm.shared import Scratch

SCHEMA = "conv_id long, turn long, role string, text string"


def words(text):
    return len(text.encode().split())


def trie_by_hand(rows, splice=True):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, role, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), text))
    turns = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    if splice:
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in turns}
        turns = {c: turns.get(c - c % 20, [])[: h[c]] + v[h[c] :] for c, v in turns.items()}
    members, children = defaultdict(list), defaultdict(set)
    for c, v in turns.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
            if d:
                children[tuple(v[: d - 1])].add(tuple(v[:d]))
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, own in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(own) - 1) * words(node[-1][1]) if node else 0
    return sorted(
        (min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children[node]), leaves[node], saved[node],
         hashlib.sha256(",".join(str(c) for c in sorted(own) if tuple(turns[c]) == node).encode()).hexdigest())
        for node, own in members.items()
    )


def got_rows(df):
    return sorted(tuple(r)[:8] for r in df.collect())


def threads(n, seed, longest=9):
    """Conversations that share beginnings, some of them equal, some empty of own turns after the splice."""
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(n * 2), n):
        for t in range(rng.randint(1, longest)):
            rows.append((c, t * rng.randint(1, 2) if t < 2 else t * 2, rng.choice(["user", "assistant"]) if t else "system", rng.choice(["a", "b b", "c, c\nc"]) if t % 3 else "hello there"))
    return rows


def test_trie_digest(spark):
    rows = threads(160, 1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got_rows(prefix_trie.trie_digest(spark, df)) == trie_by_hand(rows)
    assert got_rows(prefix_trie.conversation_trie(spark, df)) == trie_by_hand(rows, splice=False)


def test_long_conversations_and_small_blocks(spark, monkeypatch):
    """Sequences of many blocks, named three times over; ids hashed in pieces."""
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rng, rows = random.Random(2), []
    base = [rng.choice("xyz") for _ in range(90)]
    for c in range(40):
        cut = rng.choice((0, 5, 40, 41, 89, 90))
        for t, text in enumerate(base[:cut] + [rng.choice("xy") for _ in range(rng.randint(0, 6))]):
            rows.append((c, t, "user", text))
    rows += [(100 + c, t, "user", text) for c in range(17) for t, text in enumerate("same")]
    scratch = Scratch(spark)
    turns, convs = prefix_trie.numbered_turns(scratch, spark.createDataFrame(rows, SCHEMA))
    nodes = prefix_trie.build_trie(scratch, turns, convs, block=3)
    nodes = scratch.keep(nodes)
    assert got_rows(nodes) == trie_by_hand(rows, splice=False)
    intervals = nodes.select("begin", "end", "depth", "n_leaves").orderBy("begin").collect()
    assert [r.begin for r in intervals] == list(range(len(intervals)))
    for r in intervals:  # the subtree is what follows until the depth falls back
        inside = next((k for k in range(r.begin + 1, len(intervals)) if intervals[k].depth <= r.depth), len(intervals))
        assert r.end == inside


def test_ranks_are_lexicographic(spark):
    rng, scratch = random.Random(3), Scratch(spark)
    paths = {tuple(rng.randint(0, 2) for _ in range(rng.randint(0, 30))) for _ in range(80)} | {()}
    paths = dict(enumerate(rng.sample(sorted(paths), len(paths))))
    rows = [(p, i, bytes([k])) for p, v in paths.items() for i, k in enumerate(v)]
    got = prefix_trie.ranked(scratch, spark.createDataFrame([(p,) for p in paths], "path long"), spark.createDataFrame(rows, "path long, at long, key binary"), block=2)
    order = [r.path for r in got.orderBy("rank").collect()]
    assert [paths[p] for p in order] == sorted(paths.values())


def test_odd_conversations(spark):
    rows = [(1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (1, 0, "assistant", "tie"), (1, 0, "user", "tie"), (2, None, "", None), (None, 0, "user", "lost"),
            (20, 0, "user", "word " * 50_000), (21, 0, "user", "own"), (23, 0, None, "x"), (23, 1, "r", None), (-5, 0, "user", "negative"), (40, 0, "ab", "c"), (41, 0, "a", "bc"), (2**40, 5, "user", "漢字 😀\x85é")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", key string, rank int")
    assert got_rows(prefix_trie.conversation_trie(spark, df)) == trie_by_hand(rows, splice=False)
    rows = [r for r in rows if r[0] != -5]  # of a negative id the remainder is negative too
    assert got_rows(prefix_trie.trie_digest(spark, spark.createDataFrame(rows, SCHEMA))) == trie_by_hand(rows)
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.trie_digest(spark, empty).count() == 0
    assert prefix_trie.trie_digest(spark, empty).columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_given_conversations(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet")
    assert got_rows(prefix_trie.trie_digest(spark, df)) == trie_by_hand([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
