"""Growing files read at the byte, and Parquet by row groups."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from moveloom.sources import rowgroups, stores, tailing
from moveloom.streaming import ledger


def lines_of(reader, start, end):
    out = []
    for p in reader.partitions(start, end):
        for batch in reader.read(p):
            out += [(r["file"].rsplit("/", 1)[-1], r["position"], r["value"]) for r in batch.to_pylist()]
    return out


@pytest.mark.parametrize("split", [1, 2, 7, 1000])
def test_pieces_have_each_line_once(tmp_path, split):
    rng, texts = random.Random(split), {}
    for name in "abc":
        texts[name] = "".join("x" * rng.randint(0, 9) + "é" * rng.randint(0, 2) + "\n" for _ in range(40)) + "torn"
        (tmp_path / name).write_text(texts[name])
    reader = tailing.TailReader({"path": str(tmp_path), "splitBytes": str(split)})
    got = lines_of(reader, {}, reader.latestOffset())
    want, positions = [], []
    for name, text in texts.items():
        at = 0
        for line in text.split("\n")[:-1]:
            want.append((name, at, line))
            at += len(line.encode()) + 1
    assert sorted(got) == sorted(want) and not any(v == "torn" for _, _, v in got)


def test_torn_lines_come_when_they_end(tmp_path):
    (tmp_path / "in").mkdir()
    reader, path, rng = tailing.TailReader({"path": str(tmp_path / "in"), "splitBytes": "5"}), tmp_path / "in" / "log", random.Random(2)
    whole = "".join(f"line {k}{'\n' * (k % 7 == 0)}\n" for k in range(60)).encode()
    at, start, got = 0, {}, []
    while at < len(whole):
        at = min(len(whole), at + rng.randint(1, 40))
        path.write_bytes(whole[:at])
        if rng.random() < 0.3:  # a new reader, as after a restart: it has only the offset
            reader = tailing.TailReader({"path": str(tmp_path / "in"), "splitBytes": "5"})
        end = reader.latestOffset()
        got += [v for _, _, v in lines_of(reader, start, end)]
        start = end
    assert got == whole.decode().split("\n")[:-1]
    path.write_bytes(b"short\n")
    assert lines_of(reader, start, reader.latestOffset()) == []


def test_stream_over_growing_files(spark, tmp_path):
    """Cut inside a line, restarted twice, with files that appear and keys that repeat."""
    folder = tmp_path / "in" / "gen-1"
    folder.mkdir(parents=True)
    (tmp_path / "in" / "other.txt").write_text("not this\n")
    rows = [json.dumps({"id": k % 70, "v": k % 70 * 2}) + "\n" for k in range(100)]
    whole = "".join(rows)

    def drain():
        lines = tailing.follow(spark, f"file://{tmp_path}/in", "gen-*/*.jsonl", split_bytes=64)
        parsed = lines.select(F.from_json("value", "id long, v long").alias("r")).select("r.*")
        ledger.drain_new(parsed, f"{tmp_path}/out", f"{tmp_path}/state", "id")

    for cut in (333, 700, len(whole)):
        (folder / "moves.jsonl").write_text(whole[:cut])
        drain()
        seen = spark.read.parquet(f"{tmp_path}/out").select("id", "v").collect()
        expected = {k % 70 for k in range(whole[:cut].count("\n"))}
        assert sorted(r.id for r in seen) == sorted(expected) and all(r.v == 2 * r.id for r in seen)
    (folder / "more.jsonl").write_text('{"id": 500, "v": 1000}\n{"id": 1, "v": 2}\n')
    drain()
    drain()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 71


@pytest.fixture
def grouped(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    (tmp_path / "in").mkdir()
    for k in range(3):
        table = pa.table({"k": pa.array(range(k * 100, k * 100 + 100)), "s": [f"s{i % 5}" if i % 11 else None for i in range(100)], "v": pa.array([i / 2 for i in range(100)])})
        pq.write_table(table, tmp_path / "in" / f"{k}.parquet", row_group_size=10)
    return f"file://{tmp_path}/in"


def test_row_groups(spark, grouped):
    df = rowgroups.read_groups(spark, grouped, 5, 14, ["k", "s"], batch_rows=3)
    assert df.columns == ["k", "s", "row_group"] and df.rdd.getNumPartitions() == 9
    rows = df.collect()
    assert [r.k for r in sorted(rows)] == list(range(50, 140)) and all(r.row_group == r.k // 10 for r in rows)
    assert rowgroups.read_groups(spark, grouped).count() == 300 and rowgroups.count_groups(grouped) == 30
    assert rowgroups.read_groups(spark, grouped, 30).count() == 0


@pytest.mark.parametrize("condition, groups", [("k >= 95 AND k < 110", 2), ("k = 42", 1), ("k IN (1, 299)", 2), ("k > 289", 1), ("k > 299", 0), ("k <= 0", 1), ("v < 1", 3), ("s = 's1'", 30), ("s = 'zzz'", 0), ("k + 1 = 5", 30)])
def test_groups_that_statistics_exclude_are_not_opened(spark, grouped, condition, groups):
    df = rowgroups.read_groups(spark, grouped)
    kept = df.where(condition)
    opened = [p for p in range(kept.rdd.getNumPartitions())]
    assert len(opened) == groups or groups == 0 and len(opened) <= 1
    assert kept.count() == spark.read.parquet(grouped).where(condition).count()


def test_conversion_goes_on_where_it_stopped(spark, grouped, tmp_path):
    out, seen = f"file://{tmp_path}/out", []

    def work(rows):
        seen.append(sorted({r.row_group for r in rows.select("row_group").distinct().collect()}))
        return rows.where("k % 2 = 0").select("k")

    assert rowgroups.convert(spark, grouped, out, 7, work, ["k"], most_ranges=2) == 2
    assert rowgroups.converted_up_to(spark, out) == 14
    spark.createDataFrame([(-1,)], "k long").write.parquet(f"{out}/rows/first=14")  # written, but not marked
    assert rowgroups.convert(spark, grouped, out, 7, work, ["k"]) == 3
    assert rowgroups.convert(spark, grouped, out, 7, work, ["k"]) == 0
    assert seen == [list(range(a, min(30, a + 7))) for a in range(0, 30, 7)]
    assert sorted(r.k for r in spark.read.parquet(f"{out}/rows").collect()) == list(range(0, 300, 2))


def test_empty_folders(spark, tmp_path):
    assert stores.files_of(f"{tmp_path}/nothing") == []
    with pytest.raises(Exception, match="no Parquet file"):
        rowgroups.read_groups(spark, str(tmp_path)).count()


def test_large_batches_have_bounded_pieces():
    """Pieces grow with what is new, so that a large log is not read by a task for each small piece of it."""
    reader = tailing.TailReader({"path": "/nowhere", "splitBytes": "100"})
    few = reader.partitions({"a": 50}, {"a": 350})
    assert [(p.begin, p.end, p.first) for p in few] == [(50, 150, True), (150, 250, False), (250, 350, False)]
    many = reader.partitions({"a": 7}, {"a": 10_000_007, "b": 3_000_001})
    assert len(many) <= tailing.MOST_PIECES + 2
    for name, begin, end in (("a", 7, 10_000_007), ("b", 0, 3_000_001)):
        own = [p for p in many if p.path == name]
        assert own[0].begin == begin and own[-1].end == end and all(x.end == y.begin for x, y in zip(own, own[1:], strict=False))
