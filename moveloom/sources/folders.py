"""Where intermediate files of queries go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession) -> str:
    """A new folder in the shared one that `spark.checkpoint.dir` names; only a local master may go without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="moveloom-")
    return f"{root.rstrip('/')}/work-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The frame, written down and read again: what several branches of a plan read is computed once, and lineage ends."""
    path = work_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def opened(path: str) -> str:
    """A path as open() takes it; an error where only Spark reaches it."""
    if path.startswith("file:"):
        return "/" + path[len("file:") :].lstrip("/")
    if "://" in path:
        raise ValueError(f"{path}: packed records need a folder that tasks can open")
    return path
