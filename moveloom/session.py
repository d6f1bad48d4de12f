"""Session defaults shared by the bench, the tests and ad-hoc use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings that hold on a laptop and on a cluster; sizes are left to the deployment.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "moveloom", cpus: int | None = None, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the package's defaults; on a cluster build your own and pass it in."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app).config("spark.driver.memory", memory)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def carried(module: str) -> None:
    """Let workers have a module's functions and classes by value, whether or not they can import the package."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[module])
