"""Table functions, sketches, keys of sets, permutations, draws and nested exports on odd cases."""

from __future__ import annotations

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from moveloom.operators import permute, setkeys, sketches, visits
from moveloom.sources import exports


class Until:
    """Ends a group behind the row whose running sum passes ten; counts how many rows it was handed."""

    def __init__(self):
        self.total = self.handed = 0

    def __call__(self, rows):
        import numpy as np

        sums = self.total + np.cumsum(rows.column("v").to_numpy(zero_copy_only=False))
        self.total, self.handed = int(sums[-1]), self.handed + rows.num_rows
        return np.where(sums > 10, sums, 0)


def test_visitors_end_each_group_by_itself(spark):
    rng = random.Random(1)
    rows = [(g, k, rng.randint(0, 3)) for g in ("a", "b", None) for k in range(40)] + [("never", k, 0) for k in range(30)]
    got = visits.visit(spark.createDataFrame(rows, "g string, k int, v int").repartition(5), ["g"], ["k"], Until).collect()
    for g in ("a", "b", None, "never"):
        seen = sorted((r.visit, r.k, r.code) for r in got if r.g == g)
        total, want = 0, []
        for i, (_, k, v) in enumerate(r for r in rows if r[0] == g):
            total += v
            want.append((i + 1, k, total if total > 10 else 0))
            if total > 10:
                break
        assert seen == want
    assert visits.visit(spark.createDataFrame([], "g string, k int, v int"), ["g"], ["k"], Until).count() == 0


def test_a_group_that_has_ended_is_not_handed_over(spark):
    """One group far longer than a batch, ended in its first: later batches never reach the visitor."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        rows = spark.range(20_000).select(F.lit(1).alias("g"), F.col("id").alias("k"), F.lit(1).alias("v"))

        def first(batch):
            if batch.column("k")[0].as_py() >= 100:
                raise AssertionError("handed over behind the end")
            return [int(k.as_py() == 5) for k in batch.column("k")]

        assert visits.visit(rows, ["g"], ["k"], first).count() == 6
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_plies(spark):
    games = spark.createDataFrame([(1, ["e4", "e5", "f4"], 1.0), (2, None, 0.5), (3, [], 0.0), (4, ["d4"], None)], "game int, moves array<string>, outcome double")
    got = sorted(map(tuple, visits.plies(games, ["game"], "moves", "outcome", 2).collect()))
    assert got == [(1, 1, "", "e4", 1.0), (1, 2, "e4", "e5", 0.0), (4, 1, "", "d4", None)]
    with pytest.raises(Exception, match="one at least"):
        visits.plies(games, ["game"], "moves", "outcome", 0).count()
    with pytest.raises(Exception, match="list of moves"):
        visits.plies(games.withColumn("moves", F.lit("e4")), ["game"], "moves", "outcome", 2).count()


def test_sketches_of_new_files(spark, tmp_path):
    rng, store = random.Random(2), f"{tmp_path}/store"
    rows = [([rng.choice("ab") for _ in range(rng.randint(0, 3))], rng.randrange(30_000)) for _ in range(40_000)]
    games = spark.createDataFrame(rows, "moves array<string>, player int")
    half = spark.createDataFrame(rows[:20_000], games.schema), spark.createDataFrame(rows[20_000:], games.schema)

    def check(part):
        seen = {}
        for moves, player in part:
            for k in range(1, min(2, len(moves)) + 1):
                seen.setdefault((k, " ".join(moves[:k])), set()).add(player)
        got = {(r.k, r.prefix): r.estimate for r in sketches.counted(spark, store).collect()}
        assert set(got) == set(seen) and all(abs(got[n] - len(s)) <= 1 + 4 * 1.04 / 64 * len(s) for n, s in seen.items())

    sketches.add_file(sketches.sketched(half[0], "moves", "player", 2), store, "one")
    check(rows[:20_000])
    first = sorted(p.name for p in (tmp_path / "store" / "file=one").iterdir())
    for _ in range(2):  # the same file again changes nothing
        sketches.add_file(sketches.sketched(half[1], "moves", "player", 2), store, "two")
        check(rows)
    assert sorted(p.name for p in (tmp_path / "store" / "file=one").iterdir()) == first


@pytest.mark.parametrize("confused", [False, True])
def test_equal_sets(spark, monkeypatch, confused):
    if confused:  # keys that tell only eight sets apart
        monkeypatch.setattr(setkeys, "item_bits", lambda *item, seed=0: F.pmod(F.xxhash64(*item), F.lit(8)).cast("long"))
    rng = random.Random(3)
    sets = {g: [rng.choice("abcd") for _ in range(rng.randint(1, 4))] for g in range(80)}
    rows = [(g, x) for g, v in sets.items() for x in v]
    got = dict(map(tuple, setkeys.equal_sets(spark.createDataFrame(rows, "g long, x string").repartition(4), "g", "x").collect()))
    classes = {}
    for g, v in sets.items():
        classes.setdefault(frozenset(v), []).append(g)
    assert got == {g: min(c) for c in classes.values() if len(c) > 1 for g in c}


def test_states_do_not_depend_on_order(spark):
    rows = [(1, k, x) for k, x in enumerate("abcbacab")] + [(2, k, x) for k, x in enumerate("cab")]
    got = {(r.g, r.k): r.state for r in setkeys.toggled(spark.createDataFrame(rows, "g int, k int, x string"), ["g"], [F.col("k")], F.col("x")).collect()}
    assert got[1, 2] == got[2, 2] and got[1, 5] == 0 and got[1, 6] == got[1, 0] and got[1, 7] == got[1, 1] and len({got[1, k] for k in range(3)}) == 3


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 99, 100, 101, 1000])
def test_permutations(spark, n):
    for seed in (1, 2):
        places = [r.place for r in permute.permuted(spark.range(n), "id", n, seed).orderBy("id").collect()]
        assert places == [permute.permuted_number(x, n, seed) for x in range(n)]
        assert sorted(places) == list(range(n))
    a, b = permute.sides(n)
    assert n <= a * b < n + a


def test_permutations_move_rows(spark):
    n = 5000
    places = [permute.permuted_number(x, n, 4) for x in range(n)]
    assert sum(p == x for x, p in enumerate(places)) < 10
    steps = Counter((places[x + 1] - places[x]) % n for x in range(n - 1))
    assert steps.most_common(1)[0][1] < 12  # neighbours are not carried along
    first = sum(p < n // 2 for p in places[: n // 2])
    assert abs(first - n / 4) < 120


def test_shuffled_windows(spark):
    rows = spark.range(250).select((F.col("id") * 3).alias("k"))
    got = permute.shuffled(rows, "k", 5, 100).collect()
    assert Counter(r.window for r in got) == {0: 100, 1: 100, 2: 50} and len({(r.window, r.slot) for r in got}) == 250
    assert got == permute.shuffled(rows.repartition(7), "k", 5, 100).collect() or sorted(got) == sorted(permute.shuffled(rows.repartition(7), "k", 5, 100).collect())
    assert permute.shuffled(rows.where("k < 0"), "k", 5, 100).count() == 0


@pytest.mark.parametrize("weights", [{"a": 1.0}, {"a": 0.0, "b": 2.0}, {"a": 1.0, "b": 3.0, "c": 0.5, "d": 3.5}, {f"k{i}": float(i % 7) for i in range(40)}])
def test_alias_tables_keep_weights(weights):
    slots, share = permute.alias_table(weights), Counter()
    for c, kept, other in slots:
        assert 0 <= kept <= 1 + 1e-9
        share[c] += kept / len(slots)
        share[other] += (1 - kept) / len(slots)
    total = sum(weights.values())
    assert all(share[c] == pytest.approx(w / total, abs=1e-9) for c, w in weights.items())


def test_draws_follow_weights(spark):
    weights = {"a": 1.0, "b": 3.0, "c": 0.0, "d": 4.0}
    rows = spark.range(40_000)
    got = permute.drawn(rows, "id", weights, 1)
    counts = {r.category: r["count"] for r in got.groupBy("category").count().collect()}
    assert "c" not in counts and all(abs(counts[c] - 40_000 * w / 8) < 5 * (40_000 * w / 8) ** 0.5 for c, w in weights.items() if w)
    assert sorted(got.collect()) == sorted(permute.drawn(rows.repartition(3), "id", weights, 1).collect())
    for wrong in ({}, {"a": 0.0}, {"a": -1.0, "b": 2.0}, {"a": float("nan")}):
        with pytest.raises(ValueError):
            permute.alias_table(wrong)


def test_exports_with_drifting_fields(spark, tmp_path):
    player = lambda name, **more: {"user": {"name": name}, **more}
    docs = [
        {"id": "1", "speed": "blitz", "status": "mate", "winner": "white", "players": {"white": player("ME", rating=1500), "black": player("x", rating="1450")}, "moves": "e4 e5  Qh5 "},
        {"id": "2", "status": "resign", "winner": "white", "players": {"white": player("y"), "black": player("me", rating={"value": 1600})}, "moves": ""},
        {"id": 3, "status": "draw", "players": {"white": player("me", rating=None), "black": {"aiLevel": 3}}, "clock": {"initial": 60}},
        {"id": "4", "status": "started", "players": {"white": player("me"), "black": player("z")}},
        {"id": "5", "status": "mate", "players": {"white": player("others"), "black": player("z")}},
        {"id": "6", "players": {"white": player("me"), "black": player("z")}}, [1, 2], "text", 7, {"id": "8", "status": "mate", "players": "gone"},
        {"id": "9", "status": "mate", "winner": "black", "players": {"white": player("me", rating=[1]), "black": player("w", rating=1700.4)}, "moves": 5},
    ]
    (tmp_path / "x.jsonl").write_text("".join(json.dumps(d) + "\n" for d in docs) + "{torn\n\n")
    got = {r.id: r for r in exports.flattened(exports.read_export(spark, str(tmp_path / "x.jsonl")), "Me").collect()}
    assert set(got) == {"1", "2", "3", "9"}
    assert tuple(got["1"]) == ("1", "blitz", "white", "x", 1500, 1450, 1.0, 3, 50)
    assert tuple(got["2"]) == ("2", None, "black", "y", 1600, None, 0.0, 0, None)
    assert tuple(got["3"]) == ("3", None, "white", None, None, None, 0.5, 0, None)
    assert got["9"].rating is None and got["9"].opponent_rating == 1700 and got["9"].points == 0.0 and got["9"].plies == 1
