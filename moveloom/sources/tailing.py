"""Growing text files as a stream of lines, resumed at the byte.

An offset is a byte for each file. A batch ends behind the last line end that a file has when it is planned, so a line
that is still being written is not read; it comes with the batch after its end was written. A file's new bytes are cut into
pieces of `splitBytes`, or of more where a batch would have more than MOST_PIECES of them; a piece has the lines that start in
it, so pieces are read by as many tasks.

Defined cases: files may appear at any time; one that is gone or shorter than its offset has nothing new until it is
longer; empty lines are lines; bytes that are no UTF-8 become replacement characters; a line may be longer than a piece.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..session import carried
from .stores import files_of, store_of

SCHEMA = T.StructType([T.StructField("file", T.StringType()), T.StructField("position", T.LongType()), T.StructField("value", T.StringType())])
_BLOCK = 1 << 16
_ROWS = 5000
#: Pieces of a batch, beside one for each file.
MOST_PIECES = 400


def whole_lines(path: str, known: int, size: int, store=None) -> int:
    """The byte behind the last line end in known..size; known if there is none."""
    fs, _ = (store, None) if store else store_of(path)
    with fs.open_input_file(path) as f:
        end = size
        while end > known:
            start = max(known, end - _BLOCK)
            f.seek(start)
            if (at := f.read(end - start).rfind(b"\n")) >= 0:
                return start + at + 1
            end = start
    return known


class Piece(InputPartition):
    def __init__(self, path: str, begin: int, end: int, first: bool):
        self.path, self.begin, self.end, self.first = path, begin, end, first


class TailReader(DataSourceStreamReader):
    def __init__(self, options):
        self.folder, self.pattern = options["path"], options.get("pattern", "*")
        self.split = int(options.get("splitBytes", str(64 << 20)))
        self.ends: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, _ = store_of(self.folder)
        for path, size in files_of(self.folder, self.pattern):
            known = self.ends.get(path, 0)
            if size > known:
                self.ends[path] = whole_lines(path, known, size, store)
        return dict(self.ends)

    def partitions(self, start: dict, end: dict) -> Sequence[Piece]:
        out = []
        fresh = sum(max(0, last - start.get(path, 0)) for path, last in end.items())
        split = max(self.split, -(-fresh // MOST_PIECES))
        for path, last in sorted(end.items()):
            begin = start.get(path, 0)
            out += [Piece(path, a, min(last, a + split), a == begin) for a in range(begin, last, split)]
        return out

    def read(self, partition: Piece) -> Iterator:
        import pyarrow as pa

        store, _ = store_of(self.folder)
        with store.open_input_file(partition.path) as f:
            # a piece within a range begins behind the line that reaches into it
            at = partition.begin if partition.first else partition.begin - 1
            f.seek(at)
            held, rows, skip = b"", [], not partition.first

            def batch(rows):
                positions, values = zip(*rows, strict=True)
                return pa.RecordBatch.from_arrays([pa.array([partition.path] * len(rows)), pa.array(positions, pa.int64()), pa.array(values)], names=SCHEMA.names)

            while at < partition.end:
                block = f.read(_BLOCK)
                if not block:
                    break
                *lines, held = (held + block).split(b"\n")
                for line in lines:
                    if at >= partition.end:
                        break
                    if not skip:
                        rows.append((at, line.decode("utf-8", "replace")))
                    skip = False
                    at += len(line) + 1
                if len(rows) >= _ROWS:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)

    def commit(self, end: dict) -> None:
        for path, byte in end.items():
            self.ends[path] = max(byte, self.ends.get(path, 0))

    def stop(self) -> None:
        pass


class TailSource(DataSource):
    """format("tail"): options path (a folder), pattern (of paths below it), splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> T.StructType:
        return SCHEMA

    def streamReader(self, schema: T.StructType) -> TailReader:
        return TailReader(self.options)


def follow(spark: SparkSession, folder: str, pattern: str = "*", split_bytes: int = 64 << 20) -> DataFrame:
    """The stream (file, position, value) of whole lines."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("tail").option("path", folder).option("pattern", pattern).option("splitBytes", split_bytes).load()


def write_lines(lines: DataFrame, folder: str) -> int:
    """Write (file, number, line) as files of these names, lines in the order of numbers and as they are, without ends added; returns the bytes.

    A file is written by one task, as the writer of a log is one process.
    """
    from pyspark.sql import functions as F

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        store, base = store_of(folder)
        store.create_dir(base, recursive=True)
        name = out = None
        total = 0
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for file, group in groupby(rows, lambda r: r[0]):
                if file != name:
                    if out:
                        out.close()
                    name, out = file, store.open_output_stream(f"{base}/{file}")
                raw = "".join(line for _, line in group).encode()
                out.write(raw)
                total += len(raw)
        if out:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], names=["bytes"])

    placed = lines.select("file", "number", "line").repartition("file").sortWithinPartitions("file", "number").select("file", "line")
    return placed.mapInArrow(run, "bytes long").agg(F.sum("bytes").alias("bytes")).first().bytes


carried(__name__)
