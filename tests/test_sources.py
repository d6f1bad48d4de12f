"""Readers and writers on small files."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from moveloom.sources import boards, records, texts


def some_records(n: int, seed: int = 1) -> bytes:
    rng, out = np.random.default_rng(seed), np.zeros(n, records.RECORD)
    for i in range(n):
        men = int(rng.integers(2, 33))
        out[i]["stm"], out[i]["count"], out[i]["score"], out[i]["result"] = i % 2, men, rng.integers(-2000, 2000), i % 3
        out[i]["squares"][:men] = rng.choice(64, men, replace=False)
        out[i]["pieces"][:men] = rng.integers(0, 12, men)
    return out.tobytes()


def test_records_round_trip(spark, tmp_path):
    raw = some_records(1000)
    (tmp_path / "a.bin").write_bytes(raw)
    df = records.read_records(spark, str(tmp_path / "a.bin"), per_partition=300)
    assert df.rdd.getNumPartitions() == 4
    assert records.to_bytes(df.collect()) == raw
    assert records.to_bytes(records.read_record_store(spark, str(tmp_path)).collect()) == raw


def test_record_limits(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(some_records(10))
    assert records.read_records(spark, str(tmp_path / "a.bin"), limit=4).count() == 4
    with pytest.raises(Exception, match="asked for"):
        records.read_records(spark, str(tmp_path / "a.bin"), limit=11).count()
    (tmp_path / "b.bin").write_bytes(b"x" * 71)
    with pytest.raises(Exception, match="whole number"):
        records.read_records(spark, str(tmp_path / "b.bin")).count()


def test_packed_positions(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(some_records(50))
    df = records.read_records(spark, str(tmp_path / "a.bin"))
    for whole, packed in zip(df.collect(), records.pack(df).collect(), strict=True):
        squares = sorted(zip(whole.squares, whole.pieces, strict=True))
        bits = packed.occupied & 0xFFFFFFFFFFFFFFFF
        assert [s for s in range(64) if bits >> s & 1] == [s for s, _ in squares]
        nibbles = [c for b in packed.codes for c in (b >> 4, b & 15)]
        assert nibbles[: whole.men] == [p for _, p in squares] and len(packed.codes) == 16


PGN = '[Event "x"]\n[White "A"]\n[Black "B"]\n[Result "1-0"]\n\n1. e4 { [%clk 0:00:10] [%eval 0.3,12] } e5 2. Nf3 1-0\n\n[Event "y"]\n[White "B"]\n[Black "C"]\n[Result "*"]\n\n1. d4 {[%eval #-3]} *\n\n[Event "z"]\n[White "C"]\n[Result "1/2-1/2"]\n\n1/2-1/2\n'


def test_pgn(spark, tmp_path):
    (tmp_path / "g.pgn").write_text(PGN)
    games = texts.read_pgn(spark, str(tmp_path / "g.pgn"))
    rows = {r.white: r for r in games.collect()}
    assert {k: r.score for k, r in rows.items()} == {"A": 1.0, "B": None, "C": 0.5} and rows["C"].black == "?"
    tokens = {r.white: r.t for r in games.select("white", texts.movetext_tokens(F.col("movetext")).alias("t")).collect()}
    assert tokens == {"A": ["e4", "e5", "Nf3"], "B": ["d4"], "C": []}
    evals = games.select("white", F.transform(texts.comments_of(F.col("movetext"), "eval"), texts.eval_cp).alias("e"), F.transform(texts.comments_of(F.col("movetext"), "clk"), texts.clock_seconds).alias("c"))
    assert {r.white: (r.e, r.c) for r in evals.collect()} == {"A": ([30], [10.0]), "B": ([-3000], []), "C": ([], [])}


def test_epd(spark, tmp_path):
    (tmp_path / "b.epd").write_text("# note\n\n8/8/8/8/8/8/8/K6k w - - bm Ka2; id \"one\";\n8/8/8/8/8/8/8/K6k b - - 0 1\n")
    rows = texts.read_epd(spark, str(tmp_path / "b.epd")).collect()
    assert [r.key for r in rows] == ["8/8/8/8/8/8/8/K6k w - -", "8/8/8/8/8/8/8/K6k b - -"]
    assert rows[0].ops == {"bm": "Ka2", "id": "one"} and rows[1].ops == {}
    (tmp_path / "e.epd").write_text("# nothing\n")
    with pytest.raises(ValueError, match="no position"):
        texts.read_epd(spark, str(tmp_path / "e.epd"), refuse_empty=True)


def test_torn_line_is_left(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"game": 1, "move": "e4"}\n{"game": 2, "mo')
    assert [r.game for r in texts.read_json_lines(spark, str(tmp_path / "l.jsonl"), "game int, move string").collect()] == [1]


def test_ledger_and_tsv(spark, tmp_path):
    texts.write_tsv(spark.createDataFrame([(1, None, "a\tb\nc")], "x int, y string, z string"), str(tmp_path / "t"))
    lines = [line for p in (tmp_path / "t").glob("*.csv") for line in p.read_text().splitlines()]
    assert set(lines) == {"x\ty\tz", "1\t-\ta b c"}
    (tmp_path / "l.tsv").write_text("date\tnetwork\tbase\tchange\tchunks\tgames\telo\tmargin95\tverdict\tsource\n2020-01-01\tn\t-\tc\ta, b\t10\t1.5\t-\tok\ts\n")
    r = texts.read_ledger(spark, str(tmp_path / "l.tsv")).first()
    assert r.chunks == ["a", "b"] and r.base is None and r.margin95 is None and r.elo == 1.5


def test_jobs_by_state(spark, tmp_path):
    for state, name in (("pending", "002.json"), ("done", "001.json")):
        (tmp_path / state).mkdir()
        (tmp_path / state / name).write_text('{"id": "%s"}' % name)
    got = {(r.id, r.state) for r in texts.read_jobs(spark, str(tmp_path), "id string").collect()}
    assert got == {("002.json", "pending"), ("001.json", "done")}


def test_epd_sink(spark, tmp_path):
    texts.write_epd(spark.createDataFrame([(2, "b"), (1, "a")], "at int, line string"), str(tmp_path / "o"), ["made by hand"])
    assert next((tmp_path / "o").glob("*.txt")).read_text().splitlines() == ["# made by hand", "a", "b"]


def test_boards(spark):
    fen = "rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq - 0 1"
    r = spark.createDataFrame([(fen,)], "fen string").select(boards.expand_placement(F.col("fen")).alias("s")).select("s", boards.material_signature(F.col("s")).alias("m")).first()
    assert len(r.s) == 64 and r.s[36] == "P" and r.m == "KQRRBBNNPPPPPPPPvKQRRBBNNPPPPPPPP"


def test_book(spark, tmp_path):
    rows = spark.createDataFrame([Row(key=-1, move=5, weight=70000), Row(key=3, move=7, weight=2)])
    assert boards.write_book(rows, str(tmp_path / "b.bin")) == 2
    raw = (tmp_path / "b.bin").read_bytes()
    assert raw[:8] == (3).to_bytes(8, "big") and raw[16:24] == b"\xff" * 8 and raw[26:28] == b"\xff\xff"


def test_pgn_sink(spark):
    plies = spark.createDataFrame([(1, 2, "e5", "0:09"), (1, 1, "e4", "0:10")], "game int, ply int, move string, clk string")
    assert texts.pgn_of(plies, "game", "ply", "move", "clk").first().movetext == "1. e4 {[%clk 0:10]} e5 {[%clk 0:09]}"


def squeezed(board: str, flag: int = 0) -> bytes:
    nibbles, i = [], 0
    while i < 64:
        if board[i] == " ":
            run = len(board[i:]) - len(board[i:].lstrip(" "))
            while run:
                nibbles += [12, min(run, 16) - 1]
                i += min(run, 16)
                run -= min(run, 16)
        else:
            nibbles.append(boards.NIBBLE_PIECES.index(board[i]))
            i += 1
    if len(nibbles) % 2:
        nibbles.append(15)
    return bytes([flag]) + bytes(a << 4 | b for a, b in zip(nibbles[::2], nibbles[1::2], strict=True)) + b"\0" * 6


def test_nibble_boards(spark):
    from random import Random

    rng = Random(1)
    rows = []
    for i in range(60):
        board = [" "] * 64
        for s in rng.sample(range(64), rng.randint(2, 32)):
            board[s] = rng.choice(boards.NIBBLE_PIECES)
        rows.append((i, "".join(board), bytearray(squeezed("".join(board), i % 2)), 100 + i))
    df = spark.createDataFrame(rows, "i int, want string, fen binary, score int").withColumn("depth", F.lit(9))
    assert all(r.got == r.want for r in df.select("want", boards.decompress(F.col("fen")).alias("got")).collect())
    got = boards.evaluated_positions(df, 5).collect()
    assert len(got) == 60
    for r, (i, board, _, score) in zip(got, rows, strict=True):
        want = {(7 - s // 8) * 8 + s % 8: (6 if p.islower() else 0) + "PNBRQK".index(p.upper()) for s, p in enumerate(board) if p != " "}
        assert dict(zip(r.squares, r.pieces, strict=True)) == want and r.men == len(want) and (r.stm, r.score) == ((1, -score) if i % 2 else (0, score))
    bad = spark.createDataFrame([(bytearray(b"\x04" + b"\xc0" * 20),), (bytearray(b"\x00\x01"),), (bytearray(b"\x00" + b"\x11" * 10 + b"\0" * 6),)], "fen binary")
    assert [r[0] for r in bad.select(boards.decompress(F.col("fen"))).collect()] == [None, None, None]


def test_pgn_with_carriage_returns_and_repeated_headers(spark, tmp_path):
    text = PGN.replace('[Result "1-0"]', '[White "A2"]\n[Result "1-0"]').replace("\n", "\r\n")
    (tmp_path / "g.pgn").write_bytes(b"\xef\xbb\xbf" + text.encode())
    rows = {r.white: r for r in texts.read_pgn(spark, str(tmp_path / "g.pgn")).collect()}
    assert set(rows) == {"A2", "B", "C"} and rows["A2"].result == "1-0" and rows["A2"].headers["Event"] == "x" and "\r" not in rows["B"].movetext


def test_epd_with_a_repeated_operation(spark, tmp_path):
    (tmp_path / "a.epd").write_text('8/8/8/8/8/8/8/Kk6 w - - bm a1; ce 5; bm b2; id "x";\n')
    assert texts.read_epd(spark, str(tmp_path / "a.epd")).first().ops == {"bm": "b2", "ce": "5", "id": "x"}


def test_whole_logs_refuse_bad_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n{"a": \n')
    assert [r.a for r in texts.read_json_lines(spark, str(tmp_path / "a.jsonl"), "a long").collect()] == [1]
    with pytest.raises(Exception):
        texts.read_json_lines(spark, str(tmp_path / "a.jsonl"), "a long", whole=True).collect()


def test_files_of_the_manifest(spark):
    files = spark.createDataFrame([("a", 5), ("b", 7), ("c", 9)], "path string, size long")
    manifest = spark.createDataFrame([("a", 5), ("b", 8), ("d", 1)], "path string, size long")
    assert [r.path for r in texts.checked_files(manifest, files).collect()] == ["a"]


def test_record_sink(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(some_records(500))
    rows = records.read_records(spark, str(tmp_path / "a.bin"), per_partition=90)
    folder = str(tmp_path / "out")
    assert records.write_records(rows, folder) and not records.write_records(rows, folder, skip_if_exists=True)
    shards = records.shards_of(folder)
    assert len(shards) == 6 and not [f for f in __import__("os").listdir(folder) if "tmp" in f]
    assert b"".join(open(s, "rb").read() for s in shards) == some_records(500)
    assert records.write_records(rows.limit(10), folder) and sum(n for _, n in records.union_report(*records.shards_of(folder))) == 10
    assert records.union_report(str(tmp_path / "a.bin"), limit=7) == [(str(tmp_path / "a.bin"), 7)]
    (tmp_path / "b.bin").write_bytes(b"x" * 71)
    with pytest.raises(ValueError, match="whole number"):
        records.union_report(str(tmp_path / "b.bin"))
    with pytest.raises(Exception, match="as many as men"):
        records.write_records(rows.withColumn("men", F.lit(2).cast("byte")), str(tmp_path / "bad"))
