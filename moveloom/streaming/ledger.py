"""Append-only logs as streams: deduplicated, folded, joined to a static table, resumed by checkpoint.

A run drains what has landed and stops; run again with the same folders, it takes up where it stopped and
folds each line once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def land(rows: DataFrame, folder: str, files: int) -> None:
    """Write rows as a number of JSON files, the unit in which a stream takes up new lines."""
    rows.repartition(files).write.mode("append").json(folder)


def land_part(rows: DataFrame, folder: str) -> None:
    """Append a part of a log as JSON files, one for each of its tasks; a stream that runs after each part takes the parts in order."""
    rows.write.mode("append").json(folder)


STOPS = "key long, stopped_at long, llr double"


def stops(lines: DataFrame, key: str, points: str, order: str, s0: float, s1: float, least: int, alpha: float = 0.05, beta: float = 0.05) -> DataFrame:
    """Where each key's sequential test stops, once: its state is three running sums, and what comes after the stop is passed over."""
    import math

    bound = math.log((1 - beta) / alpha)

    def update(name, batches, state):
        import pandas as pd

        n, total, squares, stopped = state.get if state.exists else (0, 0.0, 0.0, False)
        rows = [pdf[[order, points]] for pdf in batches]
        found = []
        if not stopped:
            for x in pd.concat(rows).sort_values(order)[points]:
                n, total, squares = n + 1, total + float(x), squares + float(x) * float(x)
                mean = total / n
                variance = squares / n - mean * mean
                llr = 0.0 if variance <= 1e-12 else n * (s1 - s0) * (2 * mean - s0 - s1) / (2 * variance)
                if n >= least and abs(llr) >= bound:
                    stopped = True
                    found.append((int(name[0]), n, llr))
                    break
        state.update((n, total, squares, stopped))
        yield pd.DataFrame(found, columns=["key", "stopped_at", "llr"])

    return lines.groupBy(key).applyInPandasWithState(update, STOPS, "n long, total double, squares double, stopped boolean", "append", "NoTimeout")


def tail(spark: SparkSession, folder: str, schema: T.StructType, per_batch: int = 4, key: str | None = None, time: str = "ts") -> DataFrame:
    """The lines of a growing folder; per_batch bounds what is in flight. With a key each key comes once within a day of event time.

    The day bounds the state; drain_new() drops keys that come again at any distance.
    """
    lines = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).json(folder)
    return lines if key is None else lines.withWatermark(time, "1 day").dropDuplicatesWithinWatermark([key])


def drain(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Append everything that has landed to a Parquet folder, exactly once per checkpoint."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def drain_new(stream: DataFrame, out: str, checkpoint: str, key: str) -> None:
    """Append what has landed, each key once, whatever batch or run brings it.

    What was seen is the output itself, whose key column each batch is held against, so the stream keeps no state that grows
    in memory; a repeated batch overwrites itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates([key])
        if number:
            seen = batch.sparkSession.read.schema(batch.schema).parquet(f"{out}/batch=*")
            before = F.regexp_extract(F.input_file_name(), r"/batch=(\d+)/", 1).cast("long")
            fresh = fresh.join(seen.where(before < number).select(key), key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def fold_into(stream: DataFrame, folder: str, checkpoint: str, by: list[str], aggregates: dict[str, str]) -> None:
    """Partial sums of each batch are appended under the batch's number; a repeated batch overwrites itself, so each line counts once."""

    def write(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy(*by).agg(*(F.expr(e).alias(n) for n, e in aggregates.items()))
        sums.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def folded(spark: SparkSession, folder: str, by: list[str], merge: dict[str, str]) -> DataFrame:
    """The cumulative state: partial sums of all batches merged."""
    return spark.read.parquet(folder).groupBy(*by).agg(*(F.expr(e).alias(n) for n, e in merge.items()))
