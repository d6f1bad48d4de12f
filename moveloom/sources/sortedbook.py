"""Entries in the total order of their keys, written as one file per range with a sparse index, and looked up by block.

An entry has 16 bytes, big-endian: `key u8, move u2, weight u2, learn u4`. Keys are unsigned; a column holds them as
signed 64-bit numbers with the same bits. The files one after the other are what one sorted file would be. Beside each
lies an index: the key of every STEP-th entry. A manifest, written last, names the files with their first and last keys
and numbers of entries; what it does not name is not part of the book, so nobody meets half of one.

Defined cases: equal keys come by weight, heaviest first, then by move and learn; nulls count as 0; weights are cut at
65535; a range without entries has no file; a book without entries has a manifest without files.
"""

from __future__ import annotations

import bisect
import json
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import carried
from .stores import store_of

#: The layout of an entry.
ENTRY = np.dtype([("key", ">u8"), ("move", ">u2"), ("weight", ">u2"), ("learn", ">u4")])
SCHEMA = T.StructType([T.StructField("key", T.LongType()), T.StructField("move", T.IntegerType()), T.StructField("weight", T.IntegerType()), T.StructField("learn", T.LongType())])
STEP = 256
_PART = "part int, file string, first long, last long, entries long"


def _unsigned(key):
    """Signed numbers in the order of the same bits without sign."""
    return key.bitwiseXOR(F.lit(-(1 << 63)))


def bytes_of(batch) -> bytes:
    out = np.zeros(batch.num_rows, ENTRY)
    for k, name in enumerate(ENTRY.names):
        values = batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64)
        out[name] = values.view(np.uint64) if name == "key" else values
    return out.tobytes()


def entries_of(raw: bytes):
    import pyarrow as pa

    rows = np.frombuffer(raw, ENTRY)
    columns = [rows["key"].astype(np.uint64).view(np.int64), rows["move"].astype(np.int32), rows["weight"].astype(np.int32), rows["learn"].astype(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=SCHEMA.names)


def manifest_of(folder: str) -> list[dict] | None:
    """The files in order, or nothing where no book is finished."""
    from pyarrow import fs

    store, base = store_of(folder)
    if store.get_file_info(f"{base}/manifest.json").type != fs.FileType.File:
        return None
    with store.open_input_stream(f"{base}/manifest.json") as f:
        return json.loads(f.read())


def write_book(entries: DataFrame, folder: str, skip_if_exists: bool = False) -> bool:
    """Write (key, move, weight, learn); false if a finished book is there and to be skipped.

    Tasks write files under names of their own, so that one tried twice does no harm; only the small manifest, a line for
    each range, is put together on the driver.
    """
    if skip_if_exists and manifest_of(folder) is not None:
        return False
    zero = lambda c, kind: F.coalesce(F.col(c).cast(kind), F.lit(0).cast(kind)).alias(c)
    rows = entries.select(zero("key", "long"), zero("move", "int"), F.greatest(F.lit(0), F.least(zero("weight", "int"), F.lit(65535))).alias("weight"), zero("learn", "long"))
    order = [_unsigned(F.col("key")), F.col("weight").desc(), F.col("move"), F.col("learn")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        store, base = store_of(folder)
        store.create_dir(base, recursive=True)
        part, name = TaskContext.get().partitionId(), f"range-{uuid.uuid4().hex}"
        out, index, count, first, last = None, [], 0, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or store.open_output_stream(f"{base}/{name}.bin")
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            first = int(keys[0]) if not count else first
            last = int(keys[-1])
            index.append(keys[-count % STEP :: STEP])
            out.write(bytes_of(batch))
            count += batch.num_rows
        if out:
            out.close()
            with store.open_output_stream(f"{base}/{name}.idx") as f:
                f.write(np.concatenate(index).astype(np.int64).view(np.uint64).astype(">u8").tobytes())
        rows = [(part, name, first, last, count)] if count else []
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split(" ")[0] for c in _PART.split(", ")])

    parts = sorted(placed.mapInArrow(run, _PART).collect())  # a row for each range
    store, base = store_of(folder)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/manifest.json") as f:
        f.write(json.dumps([{"file": p.file, "first": p.first, "last": p.last, "entries": p.entries} for p in parts]).encode())
    return True


def _finished(folder: str) -> list[dict]:
    found = manifest_of(folder)
    if found is None:
        raise ValueError(f"{folder} has no finished book")
    return found


def read_book(spark: SparkSession, folder: str, per_piece: int = 1 << 20) -> DataFrame:
    """All entries; a piece of a file is a task's unit."""
    pieces = [(p["file"], a, min(per_piece, p["entries"] - a)) for p in _finished(folder) for a in range(0, p["entries"], per_piece)]
    listed = spark.createDataFrame(pieces, "file string, first long, entries long").repartition(max(1, len(pieces)))

    def run(batches: Iterator) -> Iterator:
        store, base = store_of(folder)
        for batch in batches:
            for piece in batch.to_pylist():
                with store.open_input_file(f"{base}/{piece['file']}.bin") as f:
                    f.seek(piece["first"] * ENTRY.itemsize)
                    left = piece["entries"]
                    while left:
                        n = min(left, 50_000)
                        yield entries_of(f.read(n * ENTRY.itemsize))
                        left -= n

    return listed.mapInArrow(run, SCHEMA)


class Book:
    """Blocks of a book, opened when a key may lie in them; `opened` counts them."""

    def __init__(self, folder: str, parts: list[dict]):
        self.store, self.base = store_of(folder)
        self.parts = parts
        self.firsts = [p["first"] & 0xFFFFFFFFFFFFFFFF for p in parts]
        self.indexes: dict[str, list[int]] = {}
        self.opened = 0
        self.block: tuple[str, int] | None = None
        self.rows = np.zeros(0, ENTRY)

    def _index(self, file: str) -> list[int]:
        if file not in self.indexes:
            self.indexes = {}  # keys come in order: one file's index at a time
            with self.store.open_input_file(f"{self.base}/{file}.idx") as f:
                self.indexes[file] = np.frombuffer(f.read(), ">u8").tolist()
        return self.indexes[file]

    def _read(self, file: str, k: int) -> np.ndarray:
        if self.block != (file, k):
            with self.store.open_input_file(f"{self.base}/{file}.bin") as f:
                f.seek(k * STEP * ENTRY.itemsize)
                self.rows, self.block = np.frombuffer(f.read(STEP * ENTRY.itemsize), ENTRY), (file, k)
            self.opened += 1
        return self.rows

    def find(self, key: int) -> list[np.ndarray]:
        """The entries of an unsigned key, in pieces."""
        out = []
        for part in range(max(0, bisect.bisect_left(self.firsts, key) - 1), len(self.parts)):
            p = self.parts[part]
            if self.firsts[part] > key:
                break
            if p["last"] & 0xFFFFFFFFFFFFFFFF < key:
                continue
            index = self._index(p["file"])
            for k in range(max(0, bisect.bisect_left(index, key) - 1), len(index)):
                if index[k] > key:
                    break
                rows = self._read(p["file"], k)
                held = rows["key"].astype(np.uint64)
                a, b = np.searchsorted(held, np.uint64(key), "left"), np.searchsorted(held, np.uint64(key), "right")
                if b > a:
                    out.append(rows[a:b])
        return out


def look_up(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """The entries of the distinct keys (key); tasks have ranges of keys and open the blocks in which these may lie."""
    parts = _finished(folder)
    wanted = keys.where("key is not null").select(F.col("key").cast("long").alias("key")).distinct()
    placed = wanted.repartitionByRange(_unsigned(F.col("key"))).sortWithinPartitions(_unsigned(F.col("key")))

    def run(batches: Iterator) -> Iterator:
        book = Book(folder, parts)
        for batch in batches:
            held: list[np.ndarray] = []
            for key in batch.column(0).to_pylist():
                held += book.find(key & 0xFFFFFFFFFFFFFFFF)
                if sum(map(len, held[-64:])) > 20_000:
                    yield entries_of(b"".join(x.tobytes() for x in held))
                    held = []
            if held:
                yield entries_of(b"".join(x.tobytes() for x in held))

    return placed.mapInArrow(run, SCHEMA)


carried(__name__)
