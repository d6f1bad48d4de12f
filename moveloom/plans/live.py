"""Streams over landed files, drained to completion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.folders import work_folder
from ..sources.tables import table
from ..streaming import ledger
from .registry import query


def _landed(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    base = work_folder(spark)
    ledger.land(events.union(events.where("event_id % 9 = 0")), f"{base}/in", 6)  # some lines come twice
    return base, events.schema


@query("SELECT event_id, user_id, event_type, value FROM events")
def q99_stream_dedupe(spark, sf_dir):
    """Each key of a log once, whichever file brings it."""
    base, schema = _landed(spark, sf_dir)
    ledger.drain_new(ledger.tail(spark, f"{base}/in", schema), f"{base}/out", f"{base}/state", "event_id")
    return spark.read.schema(schema).parquet(f"{base}/out").select(*schema.names)


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, max(value) AS top FROM events GROUP BY 1")
def q100_stream_fold(spark, sf_dir):
    """A cumulative ledger, folded batch by batch."""
    base, schema = _landed(spark, sf_dir)
    ledger.drain_new(ledger.tail(spark, f"{base}/in", schema), f"{base}/once", f"{base}/seen", "event_id")
    stream = spark.readStream.schema(schema).parquet(f"{base}/once")
    ledger.fold_into(stream, f"{base}/sums", f"{base}/state", ["event_type"], {"n": "count(1)", "total": "sum(value)", "top": "max(value)"})
    out = ledger.folded(spark, f"{base}/sums", ["event_type"], {"n": "sum(n)", "total": "sum(total)", "top": "max(top)"})
    return out.withColumn("total", F.round("total", 4))


@query("SELECT e.event_id, c.c_mktsegment FROM events e JOIN customer c ON e.user_id = c.c_custkey")
def q101_stream_static_join(spark, sf_dir):
    """A log enriched from a table."""
    base, schema = _landed(spark, sf_dir)
    static = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    stream = ledger.tail(spark, f"{base}/in", schema).join(static, "user_id").select("event_id", "c_mktsegment")
    ledger.drain_new(stream, f"{base}/out", f"{base}/state", "event_id")
    return spark.read.parquet(f"{base}/out").select("event_id", "c_mktsegment")


@query("""WITH e AS (SELECT user_id, event_id, CASE WHEN value >= 50 THEN 1.0::DOUBLE WHEN value >= 20 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS x FROM events),
u AS (SELECT user_id, row_number() OVER w AS k, sum(x) OVER w AS s, sum(x * x) OVER w AS q FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
l AS (SELECT user_id, k, CASE WHEN q / k - (s / k) * (s / k) <= 1e-12 THEN 0 ELSE k * 0.2::DOUBLE * (2 * s / k - 0.4::DOUBLE - 0.6::DOUBLE) / (2 * (q / k - (s / k) * (s / k))) END AS llr FROM u)
SELECT user_id AS key, min(k) AS stopped_at FROM l WHERE k >= 10 AND abs(llr) >= ln(19.0::DOUBLE) GROUP BY user_id""")
def q128_stream_stops(spark, sf_dir):
    """Sequential tests that end as the log grows; the stream is stopped after half of it and takes up where it was."""
    points = F.when(F.col("value") >= 50, 1.0).when(F.col("value") >= 20, 0.5).otherwise(0.0)
    events = table(spark, sf_dir, "events").select("event_id", "user_id", points.alias("x"))
    base, middle = work_folder(spark), table(spark, sf_dir, "events").agg(F.median("event_id").alias("m")).first().m
    for part in (F.col("event_id") <= middle, F.col("event_id") > middle):
        ledger.land_part(events.where(part), f"{base}/in")
        lines = spark.readStream.schema(events.schema).json(f"{base}/in")
        ledger.drain(ledger.stops(lines, "user_id", "x", "event_id", 0.4, 0.6, 10), f"{base}/out", f"{base}/state")
    return spark.read.schema(ledger.STOPS).parquet(f"{base}/out").select("key", "stopped_at")
