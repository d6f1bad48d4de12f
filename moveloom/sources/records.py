"""Fixed-width position records: 70 bytes each, packed, little-endian, no header.

`stm u1, count u1, pieces u1[32], squares u1[32], score i2, result u1, engine u1`; only the first `count`
pieces and squares are live. Read as a Spark data source whose partitions are byte ranges of whole records,
so that one file of any size is read by many tasks.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: The layout of a record.
RECORD = np.dtype([("stm", "u1"), ("count", "u1"), ("pieces", "u1", 32), ("squares", "u1", 32), ("score", "<i2"), ("result", "u1"), ("engine", "u1")])
SCHEMA = T.StructType([
    T.StructField("stm", T.ByteType()), T.StructField("men", T.ByteType()), T.StructField("pieces", T.ArrayType(T.ByteType())), T.StructField("squares", T.ArrayType(T.ByteType())),
    T.StructField("score", T.ShortType()), T.StructField("result_stm", T.ByteType()), T.StructField("teacher", T.ByteType()),
])


def table_of(raw: bytes):
    """Arrow batch of whole records."""
    import pyarrow as pa

    rows = np.frombuffer(raw, RECORD)
    men = rows["count"].astype(np.int64)
    live = np.arange(32) < men[:, None]
    offsets = pa.array(np.concatenate([[0], np.cumsum(men)]), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(rows[k][live].astype(np.int8))) for k in ("pieces", "squares")]
    flat = [pa.array(rows[k].astype(t)) for k, t in (("stm", np.int8), ("count", np.int8))]
    rest = [pa.array(rows[k].astype(t)) for k, t in (("score", np.int16), ("result", np.int8), ("engine", np.int8))]
    return pa.RecordBatch.from_arrays([*flat, *lists, *rest], names=SCHEMA.names)


class Range(InputPartition):
    def __init__(self, path: str, first: int, count: int):
        self.path, self.first, self.count = path, first, count


class RecordReader(DataSourceReader):
    def __init__(self, options):
        self.paths = sorted(p for p in options["path"].split(",") if p)
        self.split = int(options.get("recordsPerPartition", "1000000"))
        self.limit = options.get("limit")

    def partitions(self) -> Sequence[Range]:
        out = []
        for path in self.paths:
            size = os.path.getsize(path)
            if size % RECORD.itemsize:
                raise ValueError(f"{path}: {size} bytes are no whole number of records")
            count = size // RECORD.itemsize
            if self.limit is not None:
                if count < int(self.limit):
                    raise ValueError(f"{path}: {count} records, {self.limit} asked for")
                count = int(self.limit)
            out += [Range(path, a, min(self.split, count - a)) for a in range(0, count, self.split)]
        return out

    def read(self, partition: Range) -> Iterator:
        with open(partition.path, "rb") as f:
            f.seek(partition.first * RECORD.itemsize)
            left = partition.count
            while left:
                n = min(left, 50_000)
                yield table_of(f.read(n * RECORD.itemsize))
                left -= n


def bytes_of(batch) -> bytes:
    """An Arrow batch with the columns of SCHEMA as packed records; the inverse of table_of."""
    out = np.zeros(batch.num_rows, RECORD)
    for name, column in zip(("stm", "count", "score", "result", "engine"), (0, 1, 4, 5, 6), strict=True):
        out[name] = batch.column(column).to_numpy(zero_copy_only=False)
    men = out["count"].astype(np.int64)
    if (men > 32).any():
        raise ValueError("a record has at most 32 pieces")
    live = np.arange(32) < men[:, None]
    for name, column in (("pieces", 2), ("squares", 3)):
        flat = batch.column(column).flatten().to_numpy(zero_copy_only=False)
        if len(flat) != men.sum():
            raise ValueError(f"{name} are not as many as men")
        out[name][live] = flat
    return out.tobytes()


class Shard(WriterCommitMessage):
    def __init__(self, written: str, name: str, count: int):
        self.written, self.name, self.count = written, name, count


class RecordWriter(DataSourceArrowWriter):
    """A shard per task under a temporary name; all get their names when the job commits, so no reader meets half of it."""

    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite = folder, overwrite

    def write(self, iterator: Iterator) -> Shard:
        from pyspark import TaskContext

        context, count = TaskContext.get(), 0
        name = f"{self.folder}/part-{context.partitionId():05d}.bin"
        os.makedirs(self.folder, exist_ok=True)
        written = f"{name}.{context.taskAttemptId()}.tmp"
        with open(written, "wb") as out:
            for batch in iterator:
                out.write(bytes_of(batch))
                count += batch.num_rows
        return Shard(written, name, count)

    def commit(self, messages) -> None:
        if self.overwrite:
            for old in os.listdir(self.folder):
                if old.endswith(".bin"):
                    os.remove(f"{self.folder}/{old}")
        for m in messages:
            if m is not None:
                os.replace(m.written, m.name) if m.count else os.remove(m.written)

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.written):
                os.remove(m.written)


class RecordSource(DataSource):
    """format("positions"): options path (comma-separated), limit per file, recordsPerPartition; writes shards into a folder."""

    @classmethod
    def name(cls) -> str:
        return "positions"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> RecordReader:
        return RecordReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> RecordWriter:
        return RecordWriter(self.options["path"], overwrite)


def write_records(records: DataFrame, folder: str, skip_if_exists: bool = False) -> bool:
    """Records with the columns of SCHEMA as shards in a folder that all tasks can open; false if that is there and to be skipped."""
    if skip_if_exists and os.path.isdir(folder) and any(f.endswith(".bin") for f in os.listdir(folder)):
        return False
    spark = records.sparkSession
    spark.dataSource.register(RecordSource)
    ordered = records.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMA))
    ordered.write.format("positions").mode("overwrite").save(folder)
    return True


def shards_of(folder: str) -> list[str]:
    return sorted(f"{folder}/{f}" for f in os.listdir(folder) if f.endswith(".bin"))


def union_report(*paths: str, limit: int = 0) -> list[tuple[str, int]]:
    """How many records a union takes of each file; a file that is no whole number of records is an error."""
    out = []
    for path in paths:
        count, rest = divmod(os.path.getsize(path), RECORD.itemsize)
        if rest:
            raise ValueError(f"{path} is no whole number of records")
        out.append((path, min(count, limit) if limit else count))
    return out


def read_records(spark: SparkSession, *paths: str, limit: int | None = None, per_partition: int = 1_000_000) -> DataFrame:
    """Records of files that tasks can open; `limit` takes the first rows of each and fails where there are fewer."""
    spark.dataSource.register(RecordSource)
    reader = spark.read.format("positions").option("path", ",".join(paths)).option("recordsPerPartition", per_partition)
    return (reader if limit is None else reader.option("limit", limit)).load()


def read_record_store(spark: SparkSession, path: str) -> DataFrame:
    """Records of files in any store that Spark reads; a file is one row, so shards should be of moderate size."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                raw = content.as_py()
                for a in range(0, len(raw), 50_000 * RECORD.itemsize):
                    yield table_of(raw[a : a + 50_000 * RECORD.itemsize])

    return files.mapInArrow(run, SCHEMA)


def to_bytes(rows) -> bytes:
    """Rows with the columns of SCHEMA as packed records."""
    out = np.zeros(len(rows), RECORD)
    for i, r in enumerate(rows):
        out[i]["stm"], out[i]["count"], out[i]["score"], out[i]["result"], out[i]["engine"] = r.stm, r.men, r.score, r.result_stm, r.teacher
        out[i]["pieces"][: r.men], out[i]["squares"][: r.men] = list(r.pieces), list(r.squares)
    return out.tobytes()


def pack(records: DataFrame) -> DataFrame:
    """The 28-byte form: a word of occupied squares, and codes of four bits in the order of squares."""
    placed = F.array_sort(F.zip_with("squares", "pieces", lambda s, p: F.struct(s.cast("int").alias("s"), p.cast("int").alias("p"))))
    bit = lambda s: F.when(s == 63, F.lit(-(1 << 63))).otherwise(F.pow(F.lit(2.0), s).cast("long"))
    occupied = F.aggregate(placed, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(bit(x["s"])))
    nibble = F.array_join(F.transform(placed, lambda x: F.lower(F.hex(x["p"]))), "")
    return records.select("stm", "men", occupied.alias("occupied"), F.unhex(F.rpad(nibble, 32, "0")).alias("codes"), "score", "result_stm", "teacher")
