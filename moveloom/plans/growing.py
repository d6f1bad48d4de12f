"""Growing inputs: logs read at the byte, Parquet by row groups, jobs that wait for one another, queues as state machines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.jobs import scheduled
from ..sources import rowgroups, tailing
from ..sources.folders import work_folder
from ..sources.tables import table
from ..streaming import ledger, queue
from .registry import query


@query("SELECT event_id, event_type, value FROM events")
def q140_tailed_log(spark, sf_dir):
    """A log in eight files that grow between two runs, the first of which meets a line in each that is not finished; some lines come twice."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    middle = events.agg(F.percentile_approx("event_id", 0.5).alias("m")).first().m
    twice = events.union(events.where("event_id % 9 = 0")).repartition("event_id")
    lines = twice.select(F.format_string("team-%d.jsonl", F.col("event_id") % 8).alias("file"), F.col("event_id").alias("number"), F.concat(F.to_json(F.struct(*events.columns)), F.lit("\n")).alias("line"))
    torn = lines.where(F.col("number") > middle).groupBy("file").agg(F.min_by(F.struct("number", "line"), "number").alias("next")).select("file", "next.number", F.substring("next.line", 1, 20).alias("line"))
    base = work_folder(spark)
    for part in (lines.where(F.col("number") <= middle).union(torn), lines):
        tailing.write_lines(part, f"{base}/in")
        read = tailing.follow(spark, f"{base}/in", "*.jsonl", split_bytes=1 << 16)
        parsed = read.select(F.from_json("value", events.schema).alias("event")).select("event.*")
        ledger.drain_new(parsed, f"{base}/out", f"{base}/state", "event_id")
    return spark.read.parquet(f"{base}/out").select(*events.columns)


_GROUPED = "SELECT l_returnflag, count(*) AS n, sum(l_quantity)::DOUBLE AS quantity, TRUE AS groups_skipped FROM lineitem WHERE l_orderkey BETWEEN (SELECT min(l_orderkey) + 100 FROM lineitem) AND (SELECT min(l_orderkey) + 900 FROM lineitem) GROUP BY 1"


@query(_GROUPED)
def q141_row_groups(spark, sf_dir):
    """A range of keys from files of small row groups: groups whose statistics exclude it are not opened, and a conversion that stopped goes on."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity")
    base, least = work_folder(spark), lines.agg(F.min("l_orderkey").alias("k")).first().k
    sorted_ = lines.repartitionByRange(12, "l_orderkey").sortWithinPartitions("l_orderkey")
    sorted_.write.option("parquet.block.size", 16 << 10).option("parquet.page.size", 4 << 10).option("parquet.block.size.row.check.min", 100).option("parquet.page.size.row.check.min", 100).parquet(f"{base}/in")
    total = rowgroups.count_groups(f"{base}/in")
    opened = []

    def work(rows):
        kept = rows.where(F.col("l_orderkey").between(least + 100, least + 900))
        opened.append(kept.rdd.getNumPartitions())
        return kept.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))

    per_range = -(-total // 3)
    rowgroups.convert(spark, f"{base}/in", f"{base}/out", per_range, work, most_ranges=1)
    rowgroups.convert(spark, f"{base}/in", f"{base}/out", per_range, work)
    sums = spark.read.parquet(f"{base}/out/rows").groupBy("l_returnflag").agg(F.sum("n").alias("n"), F.sum("quantity").cast("double").alias("quantity"))
    return sums.withColumn("groups_skipped", F.lit(sum(opened) < total))


@query("""WITH RECURSIVE j AS (SELECT o_orderkey AS id, o_orderpriority AS lane, (o_orderkey % 7 + 1) / 2.0::DOUBLE AS hours, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS earlier FROM orders),
p AS (SELECT id, lane, hours, CASE WHEN id % 97 = 5 THEN earlier END AS need, sum(hours) OVER (PARTITION BY lane ORDER BY id) - hours AS before FROM j),
r(n, id, finish) AS (SELECT 0, id, 0.0::DOUBLE FROM p UNION ALL
  SELECT n + 1, id, before + hours + max(greatest(ready, 0) - before) OVER (PARTITION BY lane ORDER BY id) FROM (
    SELECT r.n, p.id, p.lane, p.hours, p.before, coalesce(max(m.finish), 0) AS ready FROM r JOIN p ON r.id = p.id LEFT JOIN r AS m ON m.id = p.need GROUP BY ALL) WHERE n < 60)
SELECT p.id, round(r.finish - p.hours, 6) AS start, round(r.finish, 6) AS finish, FALSE AS in_cycle FROM r JOIN p ON r.id = p.id WHERE r.n = 60""")
def q142_job_schedule(spark, sf_dir):
    """When jobs start that wait for their lane and, some of them, for what an earlier order of their customer makes."""
    from pyspark.sql import Window

    orders = table(spark, sf_dir, "orders")
    earlier = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    made = lambda key: F.concat(F.lit("out/"), key.cast("string"), F.lit(".bin"))
    jobs = orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("lane"), F.lit("pending").alias("state"), F.lit(None).cast("double").alias("started"), ((F.col("o_orderkey") % 7 + 1) / 2.0).alias("hours"),
        earlier.alias("earlier"), made(F.col("o_orderkey")).alias("makes"))
    needs = F.when((F.col("id") % 97 == 5) & F.col("earlier").isNotNull(), F.array(F.concat(F.lit("./"), made(F.col("earlier")))))
    times = scheduled(jobs.withColumn("requires", needs), 0.0)
    return times.select("id", F.round("start", 6).alias("start"), F.round("finish", 6).alias("finish"), "in_cycle")


#: Three attempts, eight hours at once, twenty in all.
_RULES = queue.Rules(3, 8 * 3_600_000, 20 * 3_600_000)


@query("""WITH RECURSIVE v AS (SELECT user_id * 10 + day(ts) // 4 AS job, event_id, epoch_us(ts) // 1000 AS tm, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'fail' ELSE 'start' END AS what FROM events),
e AS (SELECT job, tm, what, row_number() OVER (PARTITION BY job ORDER BY tm, event_id) AS k FROM v UNION ALL SELECT job, (SELECT max(tm) - 60000 FROM v), 'end', count(*) + 1 FROM v GROUP BY job),
s(job, k, state, attempts, spent, started) AS (SELECT DISTINCT job, 0::BIGINT, 'pending', 0::BIGINT, 0::BIGINT, 0::BIGINT FROM v UNION ALL
  SELECT job, k, CASE WHEN what = 'start' AND state = 'pending' THEN CASE WHEN spent >= 72000000 THEN 'refused' ELSE 'running' END WHEN what = 'done' AND state = 'running' THEN 'done'
      WHEN what = 'fail' AND state = 'running' THEN CASE WHEN attempts >= 2 THEN 'failed' ELSE 'pending' END ELSE state END,
    attempts + CASE WHEN what = 'fail' AND state = 'running' THEN 1 ELSE 0 END, spent + CASE WHEN what IN ('done', 'fail') AND state = 'running' THEN tm - started ELSE 0 END,
    CASE WHEN what = 'start' AND state = 'pending' THEN tm ELSE started END
  FROM (SELECT e.job, e.k, e.tm, e.what, late, CASE WHEN late THEN CASE WHEN attempts >= 2 OR spent + most >= 72000000 THEN 'failed' ELSE 'pending' END ELSE state END AS state,
      attempts + CASE WHEN late THEN 1 ELSE 0 END AS attempts, spent + CASE WHEN late THEN most ELSE 0 END AS spent, started
    FROM (SELECT s.*, least(28800000, 72000000 - spent) AS most, s.state = 'running' AND started + least(28800000, 72000000 - spent) < n.tm AS late FROM s JOIN e AS n ON n.job = s.job AND n.k = s.k + 1) t JOIN e ON e.job = t.job AND e.k = t.k + 1))
SELECT job, state, attempts::INT AS attempts, spent FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY k DESC) AS last FROM s) WHERE last = 1 AND (state <> 'pending' OR started > 0)""")
def q143_queue_states(spark, sf_dir):
    """Jobs with attempts, budgets and limits, followed by a stream that is stopped after half of the log and goes on."""
    events = table(spark, sf_dir, "events")
    what = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "fail").otherwise("start")
    log = events.select((F.col("user_id") * 10 + F.floor(F.dayofmonth("ts") / 4)).alias("job"), F.col("event_id").alias("number"), what.alias("what"), F.col("ts").cast("timestamp").alias("ts"))
    base, middle = work_folder(spark), log.agg(F.expr("timestamp_millis(percentile_approx(unix_millis(ts), 0.5))").alias("m")).first().m
    for part in (F.col("ts") <= F.lit(middle), F.col("ts") > F.lit(middle)):
        ledger.land_part(log.where(part), f"{base}/in")
        lines = spark.readStream.schema(log.schema).json(f"{base}/in")
        queue.run(queue.transitions(lines, _RULES), f"{base}/out", f"{base}/state")
    return queue.states(spark.read.schema(queue.TRANSITIONS).parquet(f"{base}/out")).select("job", "state", "attempts", "spent")
