"""Parquet by row groups: ranges of them, batches of rows, filters against their statistics, and progress that survives a stop.

A partition is one row group. Groups are numbered over all files of a folder in the order of their paths; those outside
the asked range, and those whose statistics exclude a pushed filter, are never opened.

`convert` works through the groups range by range. A range's rows are written first and its mark after; a run that is
repeated begins behind the last mark, and a range that was written without a mark is written over.

Defined cases: a group without statistics is read; nulls count for no bound; an empty folder has no schema and is an
error; an empty range gives no rows; files added behind the last path get the next numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..session import carried
from .stores import files_of, store_of

GROUP = "row_group"


def _footers(folder: str) -> Iterator:
    """(path, footer) of each file."""
    import pyarrow.parquet as pq

    store, _ = store_of(folder)
    for path, _ in files_of(folder, "*.parquet"):
        with store.open_input_file(path) as f:
            yield path, pq.read_metadata(f)


def count_groups(folder: str) -> int:
    return sum(footer.num_row_groups for _, footer in _footers(folder))


def excluded(group, filters: Iterable[Filter]) -> bool:
    """Whether the statistics of a row group's footer leave no row to a filter."""
    known = {}
    for k in range(group.num_columns):
        column = group.column(k)
        if column.is_stats_set and column.statistics.has_min_max:
            known[column.path_in_schema] = (column.statistics.min, column.statistics.max)
    for f in filters:
        if len(f.attribute) != 1 or f.attribute[0] not in known:
            continue
        low, high = known[f.attribute[0]]
        values = f.value if isinstance(f, In) else (f.value,)
        try:
            if isinstance(f, EqualTo | In) and all(v < low or v > high for v in values):
                return True
            if isinstance(f, GreaterThan) and high <= f.value or isinstance(f, GreaterThanOrEqual) and high < f.value:
                return True
            if isinstance(f, LessThan) and low >= f.value or isinstance(f, LessThanOrEqual) and low > f.value:
                return True
        except TypeError:  # statistics of another type than the filter's value say nothing
            continue
    return False


class Group(InputPartition):
    def __init__(self, path: str, group: int, number: int):
        self.path, self.group, self.number = path, group, number


class GroupReader(DataSourceReader):
    def __init__(self, options, schema: T.StructType):
        self.folder, self.columns = options["path"], [c for c in schema.names if c != GROUP]
        first, _, last = options.get("groups", ":").partition(":")
        self.first, self.last = int(first or 0), int(last) if last else None
        self.rows, self.filters = int(options.get("batchRows", "65536")), []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons choose groups; Spark applies all filters to rows as well."""
        self.filters = [f for f in filters if isinstance(f, EqualTo | In | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual)]
        return filters

    def partitions(self) -> Sequence[Group]:
        out, number = [], 0
        for path, footer in _footers(self.folder):
            for k in range(footer.num_row_groups):
                if number >= self.first and (self.last is None or number < self.last) and not excluded(footer.row_group(k), self.filters):
                    out.append(Group(path, k, number))
                number += 1
        return out

    def read(self, partition: Group) -> Iterator:
        import pyarrow as pa
        import pyarrow.parquet as pq

        if partition is None:  # no group is left
            return
        store, _ = store_of(self.folder)
        with store.open_input_file(partition.path) as f:
            for batch in pq.ParquetFile(f).iter_batches(self.rows, row_groups=[partition.group], columns=self.columns):
                columns = dict(zip(batch.schema.names, batch.columns, strict=True))
                number = pa.array([partition.number] * batch.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*(columns[c] for c in self.columns), number], names=[*self.columns, GROUP])


class GroupSource(DataSource):
    """format("rowgroups"): options path (a folder), groups (first:last, last excluded), columns, batchRows."""

    @classmethod
    def name(cls) -> str:
        return "rowgroups"

    def schema(self) -> T.StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        found = next(iter(_footers(self.options["path"])), None)
        if found is None:
            raise ValueError(f"{self.options['path']} has no Parquet file")
        whole = from_arrow_schema(found[1].schema.to_arrow_schema())
        names = [c for c in self.options.get("columns", "").split(",") if c] or whole.names
        return T.StructType([*(whole[c] for c in names), T.StructField(GROUP, T.LongType())])

    def reader(self, schema: T.StructType) -> GroupReader:
        return GroupReader(self.options, schema)


def read_groups(spark: SparkSession, folder: str, first: int = 0, last: int | None = None, columns: Sequence[str] = (), batch_rows: int = 65536) -> DataFrame:
    """Rows of the row groups first to last - 1 with their group's number."""
    spark.dataSource.register(GroupSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("rowgroups").option("path", folder).option("groups", f"{first}:{'' if last is None else last}")
    return reader.option("columns", ",".join(columns)).option("batchRows", batch_rows).load()


_MARK = "first long, last long"


def converted_up_to(spark: SparkSession, out: str) -> int:
    """The first group that no mark covers."""
    if not files_of(f"{out}/marks"):
        return 0
    return spark.read.schema(_MARK).json(f"{out}/marks").agg({"last": "max"}).first()[0]


def convert(spark: SparkSession, folder: str, out: str, per_range: int, work: Callable[[DataFrame], DataFrame], columns: Sequence[str] = (), most_ranges: int | None = None) -> int:
    """Write work(rows) of all groups that no mark covers, per_range groups at a time; at most most_ranges ranges. Returns how many ranges it wrote."""
    total, done = count_groups(folder), 0
    first = converted_up_to(spark, out)
    while first < total and (most_ranges is None or done < most_ranges):
        last = min(total, first + per_range)
        work(read_groups(spark, folder, first, last, columns)).write.mode("overwrite").parquet(f"{out}/rows/first={first}")
        spark.createDataFrame([(first, last)], _MARK).coalesce(1).write.mode("append").json(f"{out}/marks")
        first, done = last, done + 1
    return done


carried(__name__)
