"""The pipeline's stages against plain counterparts, on one small corpus."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest

import corpus_pipeline as P
from moveloom.llm import pii, quality

from .fixtures import empty_docs, odd_docs, some_texts
from .test_documents import check_packing, classes_by_hand

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    texts = [(i, t + (" reach me at a.b@c.org" if i % 7 == 0 else "")) for i, t in some_texts(120, 9)]
    return [(i, t, "en", f"s{i % 3}", len(t)) for i, t in texts]


def test_stages(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = P.drop_low_quality(spark, docs, "")
    assert kept.columns == docs.columns
    good = {r[0] for r in rows if (m := quality.measure(r[1]))[0] >= 10 and 100 * m[4] <= 20 * m[0]}
    left = sorted((r.doc_id, r.text) for r in kept.collect())
    assert {d for d, _ in left} == good  # no host fails as a whole here
    single = P.drop_near_duplicates(spark, kept, "")
    want = {d for d, _, c in classes_by_hand(left, 5, 80) if d == c}
    assert single.columns == docs.columns and sorted(r.doc_id for r in single.collect()) == sorted(want)
    masked = P.mask_personal_data(spark, single, "")
    assert masked.schema == single.schema
    for r in masked.collect():
        before = dict(left)[r.doc_id]
        assert r.text == pii.masked(before, pii.Finder().spans(before)) and r.n_chars == len(r.text) and "@" not in r.text
    mixed = P.mix(spark, masked, "")
    copies = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns and set(copies) <= want and max(copies.values()) <= 3
    packed = P.pack(spark, mixed, "").collect()
    check_packing(packed, 2048)
    first = Counter(r.doc_id for r in packed if r.piece == 0)
    assert first == copies


def test_odd_rows(spark):
    docs = odd_docs(spark)
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns
    kept = P.drop_near_duplicates(spark, docs, "")
    by = defaultdict(int)
    for r in kept.collect():
        by[r.doc_id] += 1
    assert by[1] == 1 and 2 not in by and by[12] == 2 and by[None] == 1 and 9 not in by and by[8] == 1


def test_survivors_are_rows_not_ids(spark):
    one, two, three, four = (" ".join(f"{w}{i}" for i in range(20)) for w in ("ka", "lo", "mi", "nu"))
    rows = [(1, one), (5, two), (5, one + " end"), (7, two), (7, three), (None, four), (None, "other " + one[:40] + four[:60]), (None, three), (None, four)]
    kept = P.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    want = [(1, one), (5, two), (7, three), (None, four), rows[6]]
    assert sorted(map(tuple, kept), key=str) == sorted(want, key=str)


def written(spark) -> int:
    """Bytes of the tables in the shared folder."""
    root = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    return sum(p.stat().st_size for p in root.rglob("*.parquet") if p.is_file())


def test_quality_rules_write_no_texts(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"{rng.getrandbits(40):x}" for _ in range(500)) if i % 9 else "too short", f"s{i % 3}") for i in range(300)]
    before = written(spark)
    kept = P.drop_low_quality(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "")
    assert {r.doc_id for r in kept.collect()} == {i for i in range(300) if i % 9}
    assert written(spark) - before < 100_000  # the texts have some 1.5 MB


def test_survivors_are_not_shuffled_by_key(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(f"{rng.getrandbits(40):x}" for _ in range(12))) for i in range(3000)]
    rows += [(3000 + i, rows[i][1]) for i in range(40)] + [(4000, rows[7][1] + " end")]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10k")  # less than the keys of what stays, more than those of what goes
    try:
        kept = P.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
        ids = sorted(r.doc_id for r in kept.collect())
        plan = kept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert ids == list(range(3000))
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_empty_table(spark):
    docs = empty_docs(spark)
    for _, stage in P.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_many_hosts_are_joined_by_shuffle(spark, monkeypatch):
    from moveloom.llm import shared

    docs = odd_docs(spark)
    want = [sorted(map(str, f(spark, docs, "").collect())) for f in (P.drop_low_quality, P.mix)]
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(shared, "SALTS", 3)
    assert [sorted(map(str, f(spark, docs, "").collect())) for f in (P.drop_low_quality, P.mix)] == want


def test_run(spark):
    packed = P.run(spark, "/root/testdata/sf0.001").collect()
    check_packing(packed, 2048)
    assert packed
