"""What several operators need: table loading, scratch tables, word splitting, column names."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space characters.
WORD_GAP = r"[\x20\x09-\x0D]+"
#: Rows, and bytes, of whole texts that a Python worker is sent at once.
BATCH_ROWS = 1000
#: Rows and bytes of keys of a table of groups that may be broadcast, and into how many a group's rows are dealt beyond them.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 8 << 20
SALTS = 64
BATCH_BYTES = 8 << 20
DEFAULT_BYTES = 64 << 20


def ship(spark: SparkSession) -> None:
    """Let the Python workers import this package where it is not installed: once per context, as a zip file.

    Also bounds the Arrow batches of the session, by rows and by bytes, unless the caller has set other bounds
    than the defaults; the session keeps these settings, as frames are computed only after the call.
    """
    context = spark.sparkContext
    if not getattr(context, "_moveloom_shipped", False):
        package = Path(__file__).resolve().parent.parent
        name = Path(tempfile.mkdtemp(prefix="moveloom-")) / "moveloom.zip"
        with zipfile.ZipFile(name, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        context.addPyFile(str(name))
        context._moveloom_shipped = True
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # the default, too many for whole texts
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b") or -1) in (-1, DEFAULT_BYTES):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; only a local master (tests) may name none and has one set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="moveloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no recomputation beyond them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{scratch_root(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """Write df and read it back; the lineage before it is cut."""
        self.count += 1
        path = f"{self.base}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that keep() wrote and that nothing reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let the cleaner delete shuffle files of frames that nothing refers to any more, before the next large step.

    This only frees disk earlier than the JVM's own garbage collection would; no result depends on it.
    """
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(1)


def fresh(df: DataFrame, name: str) -> str:
    """A column name not in df, so that extra columns of the caller never clash."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_group(rows: DataFrame, groups: DataFrame, key: str, group_key: str, how: str = "left", most_rows: int | None = None) -> DataFrame:
    """rows with the columns of their group's row, null keys included in a left join; groups is written down and has a row per group.

    A small table of groups is broadcast (most_rows: of numbers as keys, so many). One beyond the bounds is joined by shuffle; there the rows of a group are
    dealt to SALTS tasks by their number, so that no group, however large, is gathered in one.
    """
    same = F.col(key) == F.col(group_key) if how == "inner" else F.col(key).eqNullSafe(F.col(group_key))
    size = groups.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col(group_key).cast("string"))).alias("bytes")).first()
    if size.n <= (BROADCAST_ROWS if most_rows is None else most_rows) and (most_rows is not None or (size.bytes or 0) <= BROADCAST_BYTES):
        return rows.join(F.broadcast(groups), same, how).drop(group_key)
    salt, group_salt = fresh(rows, "_salt"), fresh(rows, "_group_salt")
    dealt = groups.withColumn(group_salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn(salt, (F.monotonically_increasing_id() % SALTS).cast("int"))
    return salted.join(dealt, (F.col(salt) == F.col(group_salt)) & same, how).drop(salt, group_salt, group_key)


def prefix_sums(scratch: Scratch, rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with, for each name in sums, the sum of that column over all rows before in the order; ties come in any order.

    Rows are sorted in ranges; only the sums of whole ranges, a row for each task, are added up in one place.
    """
    at = fresh(rows, "_range")
    dealt = rows.select("*", *(c.alias(fresh(rows, f"_of_{n}")) for n, c in sums.items()))
    dealt = scratch.keep(dealt.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.spark_partition_id()))
    parts = {n: fresh(rows, f"_of_{n}") for n in sums}
    earlier = Window.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(at).agg(*(F.sum(p).alias(p) for p in parts.values()))
    starts = totals.select(F.col(at).alias(f"{at}_"), *(F.coalesce(F.sum(p).over(earlier), F.lit(0)).alias(f"{p}_") for p in parts.values()))
    within = Window.partitionBy(at).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = dealt.join(F.broadcast(starts), F.col(at) == F.col(f"{at}_"))  # a row for each task of the sort
    return joined.select(*rows.columns, *((F.col(f"{p}_") + F.coalesce(F.sum(p).over(within), F.lit(0))).alias(n) for n, p in parts.items()))


def word_count(text: Column) -> Column:
    """Number of words; 0 for null. Splitting leaves one empty piece at either end of white space."""
    parts = F.split(text, WORD_GAP)
    return F.coalesce(
        F.size(parts).cast("long")
        - F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0)
        - F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0),
        F.lit(0).cast("long"),
    )


def unit_hash(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) that depends only on the seed and the columns' values: 52 bits of an MD5 sum."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("")) for c in cols))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)
