"""Board codecs: FEN placement, nibble-compressed boards, and polyglot book entries."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F


def expand_placement(fen: Column) -> Column:
    """The 64 squares of a FEN's placement, rank 8 first, dots for empty ones; digits are written out."""
    squares = F.regexp_replace(F.split(fen, " ")[0], "/", "")
    for n in range(8, 0, -1):
        squares = F.regexp_replace(squares, str(n), "." * n)
    return squares


def material_signature(squares: Column) -> Column:
    """Pieces of both sides in the order KQRBNP, White's first."""
    count = lambda p: F.length(squares) - F.length(F.regexp_replace(squares, p, ""))
    side = lambda letters: F.concat(*(F.repeat(F.lit(p.upper()), count(p)) for p in letters))
    return F.concat(side("KQRBNP"), F.lit("v"), side("kqrbnp"))


def book_entry(key: int, move: int, weight: int, learn: int = 0) -> bytes:
    """16 bytes, big-endian; weights beyond 65535 are clipped."""
    return struct.pack(">QHHI", key & 0xFFFFFFFFFFFFFFFF, move, min(weight, 65535), learn)


def write_book(rows, path: str) -> int:
    """Entries (key, move, weight) sorted as a book must be. A book is one sorted file, so it is made on the driver from a streamed, sorted frame."""
    n = 0
    with open(path, "wb") as out:
        for r in rows.orderBy(F.conv(F.hex("key"), 16, 10).cast("decimal(20,0)"), F.desc("weight"), "move").toLocalIterator():
            out.write(book_entry(r.key, r.move, r.weight))
            n += 1
    return n


#: Pieces by nibble, and by code within a side.
NIBBLE_PIECES, CODE_PIECES = "KQRBNPkqrbnp", "PNBRQK"
CLAMP = 10_000


def decompress(blob: Column) -> Column:
    """The 64 squares of a nibble-compressed board, a8 first, blanks for empty ones; null if it has no 64 squares or another variant's flag.

    After a flag byte come nibbles: a piece, or 12 and the length of a gap less one; 15 ends; six bytes follow.
    """
    body = F.substring(F.hex(blob), F.lit(3), (F.octet_length(blob) - 7) * 2)
    nibbles = F.transform(F.sequence(F.lit(1), F.length(body)), lambda i: F.conv(F.substring(body, i, F.lit(1)), 16, 10).cast("int"))
    begin = F.struct(F.lit("").alias("board"), F.lit(False).alias("gap"), F.lit(False).alias("done"))

    def step(acc: Column, n: Column) -> Column:
        full = acc["done"] | (F.length(acc["board"]) >= 64)
        piece = F.substring(F.lit(NIBBLE_PIECES), n + 1, F.lit(1))
        board = F.when(full, acc["board"]).when(acc["gap"], F.concat(acc["board"], F.repeat(F.lit(" "), n + 1))).when(n < 12, F.concat(acc["board"], piece)).otherwise(acc["board"])
        return F.struct(board.alias("board"), (~full & ~acc["gap"] & (n == 12)).alias("gap"), (full | (~acc["gap"] & (n == 15))).alias("done"))

    board = F.aggregate(nibbles, begin, step)["board"]
    sound = (F.octet_length(blob) > 7) & (flags(blob).bitwiseAND(F.lit(4)) == 0)
    return F.when(sound, F.when(F.length(board) == 64, board))


def flags(blob: Column) -> Column:
    return F.conv(F.substring(F.hex(blob), F.lit(1), F.lit(2)), 16, 10).cast("int")


def evaluated_positions(rows, min_depth: int = 0, teacher: int = 10):
    """(fen binary, score of White, depth) to records; scores turn to the side that moves and are clamped. Cheap filters come first."""
    squares = F.filter(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.struct(i.alias("i"), F.substring(F.col("board"), i + 1, F.lit(1)).alias("p"))), lambda x: x["p"] != " ")
    black = (flags(F.col("fen")).bitwiseAND(F.lit(1)) == 1)
    out = rows.where((F.col("depth") >= min_depth) & F.col("score").isNotNull()).select("fen", "score", decompress(F.col("fen")).alias("board")).where("board is not null")
    out = out.select("score", black.alias("black"), squares.alias("men")).where(F.size("men").between(2, 32))
    code = lambda x: (F.when(F.upper(x["p"]) == x["p"], 0).otherwise(6) + F.position(F.upper(x["p"]), F.lit(CODE_PIECES)) - 1).cast("byte")
    square = lambda x: ((7 - F.floor(x["i"] / 8)) * 8 + x["i"] % 8).cast("byte")
    score = F.greatest(F.least(F.when(F.col("black"), -F.col("score")).otherwise(F.col("score")), F.lit(CLAMP)), F.lit(-CLAMP)).cast("short")
    return out.select(F.col("black").cast("byte").alias("stm"), F.size("men").cast("byte").alias("men"), F.transform("men", code).alias("pieces"), F.transform("men", square).alias("squares"),
                      score.alias("score"), F.lit(1).cast("byte").alias("result_stm"), F.lit(teacher).cast("byte").alias("teacher"))
