"""Books in total order: bytes of one plain sort, lookups of a join, few blocks opened."""

from __future__ import annotations

import random
import struct

import pytest
from pyspark.sql import functions as F

from moveloom.sources import sortedbook

SCHEMA = "key long, move int, weight int, learn long"


def some_entries(n, seed, keys):
    rng = random.Random(seed)
    pool = [rng.randint(-(2**63), 2**63 - 1) for _ in range(keys)] + [0, -1, 2**63 - 1, -(2**63)]
    return [(rng.choice(pool), rng.randint(0, 65535), rng.choice([1, 5, 5, 65535]), rng.randint(0, 2**32 - 1)) for _ in range(n)]


def plain_bytes(rows):
    order = sorted(rows, key=lambda r: (r[0] % 2**64, -r[2], r[1], r[3]))
    return b"".join(struct.pack(">QHHI", k % 2**64, m, w, x) for k, m, w, x in order)


@pytest.fixture(scope="module")
def book(spark, tmp_path_factory):
    rows, folder = some_entries(6000, 1, 900), f"file://{tmp_path_factory.mktemp('book')}/b"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    assert sortedbook.write_book(spark.createDataFrame(rows, SCHEMA).repartition(5), folder, skip_if_exists=True)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return rows, folder


def test_bytes_are_those_of_one_sort(book):
    rows, folder = book
    parts = sortedbook.manifest_of(folder)
    path = folder[len("file://") :]
    assert len(parts) > 3 and b"".join(open(f"{path}/{p['file']}.bin", "rb").read() for p in parts) == plain_bytes(rows)
    for p in parts:
        index = open(f"{path}/{p['file']}.idx", "rb").read()
        whole = open(f"{path}/{p['file']}.bin", "rb").read()
        assert index == b"".join(whole[k : k + 8] for k in range(0, len(whole), 16 * sortedbook.STEP))


def test_entries_come_back(spark, book):
    rows, folder = book
    assert sorted(map(tuple, sortedbook.read_book(spark, folder, per_piece=500).collect())) == sorted(rows)


def test_lookups_equal_a_join(spark, book):
    rows, folder = book
    rng = random.Random(2)
    keys = rng.sample(sorted({r[0] for r in rows}), 60) + [rng.randint(-(2**63), 2**63 - 1) for _ in range(60)] + [-1, 2**63 - 1, 0]
    wanted = spark.createDataFrame([(k,) for k in keys + keys[:5] + [None]], "key long")
    got = sorted(map(tuple, sortedbook.look_up(spark, folder, wanted).collect()))
    assert got == sorted(r for r in rows if r[0] in set(keys))
    assert sortedbook.look_up(spark, folder, wanted.where("key is null")).count() == 0


def test_one_key_opens_few_blocks(book):
    rows, folder = book
    parts = sortedbook.manifest_of(folder)
    for key in [rows[0][0], rows[1][0], 12345]:
        one = sortedbook.Book(folder, parts)
        assert sum(map(len, one.find(key % 2**64))) == sum(r[0] == key for r in rows) and one.opened <= 3


def test_a_key_over_many_blocks_and_files(spark, tmp_path):
    rows = [(7, m % 60000, 1, m) for m in range(3000)] + [(k, 1, 1, 1) for k in range(5)]
    assert sortedbook.write_book(spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/b")
    got = sortedbook.look_up(spark, f"{tmp_path}/b", spark.createDataFrame([(7,), (3,)], "key long")).collect()
    assert sorted(map(tuple, got)) == sorted(r for r in rows if r[0] in (7, 3))


def test_unfinished_and_odd_books(spark, tmp_path):
    with pytest.raises(ValueError, match="no finished book"):
        sortedbook.read_book(spark, f"{tmp_path}/none")
    empty = spark.createDataFrame([], SCHEMA)
    assert sortedbook.write_book(empty, f"{tmp_path}/b") and sortedbook.read_book(spark, f"{tmp_path}/b").count() == 0
    assert not sortedbook.write_book(empty, f"{tmp_path}/b", skip_if_exists=True)
    (tmp_path / "b" / "range-stray.bin").write_bytes(b"x" * 7)  # of a task that was tried twice
    odd = spark.createDataFrame([(None, None, 70_000, None), (5, 2, -1, 3)], SCHEMA)
    assert sortedbook.write_book(odd, f"{tmp_path}/b")
    assert sorted(map(tuple, sortedbook.read_book(spark, f"{tmp_path}/b").collect())) == [(0, 0, 65535, 0), (5, 2, 0, 3)]
    assert sortedbook.look_up(spark, f"{tmp_path}/b", odd.select("key")).where(F.col("key") == 5).count() == 1


def test_query_with_keys_beyond_64_bits(spark, tmp_path):
    """Parts from 10,001 on, as tables from a tenth of scale 1 on have them: the entries of a join by part."""
    from moveloom.plans.mechanisms import q152_sorted_book

    parts = [0, 1, 2, 10000, 10001, 15535, 20000, 1200001]
    lines = spark.createDataFrame([(p, k % 3, float(k), 10 * p + k) for p in parts for k in range(1, 6)], "l_partkey long, l_linenumber long, l_quantity double, l_orderkey long")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(p, 1 + p % 2 * 20) for p in parts], "p_partkey long, p_size long").write.parquet(f"{tmp_path}/part.parquet")
    want = lines.where("l_partkey % 2 = 0").groupBy("l_partkey", "l_linenumber").agg(F.count(F.lit(1)), F.sum("l_quantity").cast("long"), F.sum("l_orderkey")).collect()
    signed = lambda p: (p * 922337203685477 - (1 << 62) + (1 << 63)) % (1 << 64) - (1 << 63)
    assert sorted((r.key, r.move, r.n, r.weight, r.learn) for r in q152_sorted_book(spark, str(tmp_path)).collect()) == sorted((signed(r[0]), *r[1:]) for r in want)
