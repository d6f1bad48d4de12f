"""Sources and sinks: every query writes small files made from a table, reads them back and answers from what it read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.sequences import in_first_order, ranked_games
from ..sources import boards, records, texts
from ..sources.folders import opened, work_folder
from ..sources.tables import table
from .registry import query


def _records(spark, sf_dir):
    men = F.col("p_size") % 31 + 2
    lists = F.sequence(F.lit(0), men - 1)
    return table(spark, sf_dir, "part").select(
        (F.col("p_partkey") % 2).alias("stm"), men.alias("men"), F.transform(lists, lambda i: (i * 7 + F.col("p_size")) % 12).alias("pieces"), F.transform(lists, lambda i: i * 2).alias("squares"),
        F.rint("p_retailprice").cast("int").alias("score"), (F.col("p_partkey") % 3).alias("result_stm"), (F.col("p_partkey") % 12).alias("teacher"))


@query("""SELECT (p_partkey % 2)::TINYINT AS stm, count(*) AS n, sum(p_size % 31 + 2)::BIGINT AS men, sum(round_even(p_retailprice, 0))::BIGINT AS score, sum(p_partkey % 3)::BIGINT AS result, sum(p_partkey % 12)::BIGINT AS teacher,
  sum(list_sum(list_transform(range(0, p_size % 31 + 2), lambda i: (i * 7 + p_size) % 12)))::BIGINT AS pieces, sum(list_sum(list_transform(range(0, p_size % 31 + 2), lambda i: i * 2)))::BIGINT AS squares FROM part GROUP BY 1""")
def q109_record_shards(spark, sf_dir):
    """Records written as shards that get their names together, and read by ranges of whole records."""
    folder = opened(work_folder(spark))
    records.write_records(_records(spark, sf_dir), folder)
    if records.write_records(_records(spark, sf_dir), folder, skip_if_exists=True):
        raise AssertionError("what is there is not written again")
    back = records.read_records(spark, *records.shards_of(folder), per_partition=1000)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return back.groupBy("stm").agg(
        F.count(F.lit(1)).alias("n"), F.sum("men").alias("men"), F.sum("score").alias("score"), F.sum("result_stm").alias("result"), F.sum("teacher").alias("teacher"),
        F.sum(total("pieces")).alias("pieces"), F.sum(total("squares")).alias("squares"))


@query("""SELECT least(count(*), 50)::BIGINT AS taken, (p_partkey % 4)::INT AS file FROM part GROUP BY p_partkey % 4""")
def q110_record_union(spark, sf_dir):
    """A union of record files with at most 50 of each: the report of lengths, held against the rows read."""
    base = opened(work_folder(spark))
    for k in range(4):
        records.write_records(_records(spark, sf_dir).where(F.col("teacher") % 4 == k).coalesce(1), f"{base}/{k}")
    paths = [p for k in range(4) for p in records.shards_of(f"{base}/{k}")]
    report = records.union_report(*paths, limit=50)
    parts = [records.read_records(spark, path, limit=count).select(F.lit(int(path.split("/")[-2])).alias("file")) for path, count in report]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("taken"))


@query("SELECT o_custkey AS white, o_orderkey AS black, CASE o_orderstatus WHEN 'F' THEN '1-0' WHEN 'P' THEN '0-1' ELSE '1/2-1/2' END AS result, CASE o_orderstatus WHEN 'F' THEN 1.0::DOUBLE WHEN 'P' THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS score, 4 + (o_orderkey % 2)::INT AS moves, 60.0::DOUBLE + o_orderkey % 50 AS clock, (o_orderkey % 90 - 40)::INT AS eval FROM orders")
def q111_pgn(spark, sf_dir):
    """Games as PGN, half of them with carriage returns, with repeated headers, clocks and evaluations."""
    base = work_folder(spark)
    k = F.col("o_orderkey")
    result = F.when(F.col("o_orderstatus") == "F", "1-0").when(F.col("o_orderstatus") == "P", "0-1").otherwise("1/2-1/2")
    games = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", result.alias("result"))
    san = F.array(*map(F.lit, ("e4", "e5", "Nf3", "Nc6", "Bb5")))
    plies = games.select("o_orderkey", F.posexplode(F.slice(san, F.lit(1), (4 + k % 2).cast("int"))).alias("at", "san")).withColumn("at", F.col("at") + 1)
    clock = F.concat(F.lit("0:01:"), F.lpad((k % 50).cast("string"), 2, "0"))
    text = texts.pgn_of(plies.withColumn("clock", clock).withColumn("eval", F.format_string("%.2f", (k % 90 - 40) / 100)), "o_orderkey", "at", "san", "clock", "eval")
    whole = games.join(text, "o_orderkey").withColumn("movetext", F.concat_ws(" ", "movetext", "result"))
    headers = {"Event": F.lit("a [strange] event"), "Round": F.lit(1), "White": F.col("o_custkey"), "Black": F.col("o_orderkey"), "Result": F.col("result"), "Annotator": F.lit(None).cast("string"), "Round ": F.lit("2")}
    headers.pop("Round ")
    for crlf in (False, True):
        texts.write_pgn(whole.where(k % 2 == int(crlf)), f"{base}/{int(crlf)}", headers, "movetext", crlf)
    back = texts.read_pgn(spark, f"{base}/*/*.txt")
    clocks, evals = texts.comments_of(F.col("movetext"), "clk"), texts.comments_of(F.col("movetext"), "eval")
    return back.select(F.col("white").cast("long").alias("white"), F.col("black").cast("long").alias("black"), "result", "score", F.size(texts.movetext_tokens(F.col("movetext"))).alias("moves"),
                       texts.clock_seconds(F.element_at(clocks, 1)).alias("clock"), texts.eval_cp(F.element_at(evals, -1)).alias("eval"))


@query("SELECT p_partkey AS id, '8/8/8/8/8/8/8/' || p_size || ' w - -' AS key, 'e' || p_size AS bm, p_size % 9 AS ce FROM part")
def q112_epd(spark, sf_dir):
    """Positions with operations, under a commented header; an operation that comes twice has its last value."""
    base = work_folder(spark)
    size = F.col("p_size").cast("string")
    line = F.concat(F.lit("8/8/8/8/8/8/8/"), size, F.lit(" w - - bm a1; bm e"), size, F.lit("; ce "), F.col("p_size") % 9, F.lit('; id "'), F.col("p_partkey"), F.lit('";'))
    texts.write_epd(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("at"), line.alias("line")), base, ["a book", "of parts"])
    back = texts.read_epd(spark, base, refuse_empty=True)
    op = lambda n: F.try_element_at("ops", F.lit(n))
    return back.select(op("id").cast("long").alias("id"), "key", op("bm").alias("bm"), op("ce").cast("int").alias("ce"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def q113_json_lines(spark, sf_dir):
    """A log whose last line is cut short: that one is left for later, all others are read."""
    base = work_folder(spark)
    rows = table(spark, sf_dir, "events").select(F.to_json(F.struct("event_id", "event_type", "value")).alias("value"))
    rows.write.text(f"{base}/whole")
    rows.limit(1).select(F.substring("value", 1, 20).alias("value")).write.text(f"{base}/torn")
    back = texts.read_json_lines(spark, f"{base}/*/*.txt", "event_id long, event_type string, value double")
    return back.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT c_custkey::INT AS games, c_name AS network, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS base, c_acctbal AS elo, 2::INT AS chunks FROM customer")
def q114_ledger(spark, sf_dir):
    """A ledger of tab-separated cells, nulls as a dash, lists split."""
    base = work_folder(spark)
    name, none = F.col("c_name"), F.lit(None).cast("string")
    rows = table(spark, sf_dir, "customer").select(
        F.lit("2024-01-01").alias("date"), name.alias("network"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("base"), F.lit("a\tb").alias("change"), F.lit("c1, c2").alias("chunks"),
        F.col("c_custkey").alias("games"), F.col("c_acctbal").alias("elo"), none.alias("margin95"), none.alias("verdict"), none.alias("source"))
    texts.write_tsv(rows, base)
    return texts.read_ledger(spark, base).where("change = 'a b'").select("games", "network", "base", "elo", F.size("chunks").alias("chunks"))


@query("SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey % 3 = 0 THEN 'pending' WHEN n_nationkey % 3 = 1 THEN 'running' ELSE 'done' END AS state, n_name AS test FROM nation")
def q115_job_folders(spark, sf_dir):
    """A file per job in folders by state."""
    base = work_folder(spark)
    state = F.when(F.col("n_nationkey") % 3 == 0, "pending").when(F.col("n_nationkey") % 3 == 1, "running").otherwise("done")
    jobs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("test"), state.alias("state"))
    for s in ("pending", "running", "done"):
        jobs.where(F.col("state") == s).drop("state").write.option("maxRecordsPerFile", 1).json(f"{base}/{s}")
    return texts.read_jobs(spark, base, "id long, test string").select("id", "state", "test")


@query("SELECT (l_orderkey % 10)::BIGINT AS part, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_orderkey % 10 < 6 GROUP BY 1")
def q116_files_by_range(spark, sf_dir):
    """The first files of a sorted glob: what others hold is not opened."""
    base = work_folder(spark)
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 10).alias("part"), "l_quantity")
    for half in (0, 1):
        rows.where((F.col("part") >= 6) == bool(half)).write.parquet(f"{base}/group={half}")
    return spark.read.parquet(base).where("group = 0").groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("""WITH r AS (SELECT o_custkey % 8 AS file, row_number() OVER (PARTITION BY o_custkey % 8 ORDER BY o_orderkey) - 1 AS row, o_orderkey FROM orders)
SELECT r.file, r.row::BIGINT AS row, o_orderkey FROM r WHERE row % 37 = 5""")
def q117_rows_by_position(spark, sf_dir):
    """Rows of a set of (file, row) positions; the number of a row is made where the file is written and kept with it."""
    from pyspark.sql import Window

    orders = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 8).alias("file"), "o_orderkey")
    placed = orders.withColumn("row", (F.row_number().over(Window.partitionBy("file").orderBy("o_orderkey")) - 1).cast("long"))
    base = work_folder(spark)
    placed.write.partitionBy("file").parquet(base)
    kept = spark.read.schema("o_orderkey long, row long, file long").parquet(base)
    wanted = kept.groupBy("file").agg(F.max("row").alias("last")).select("file", F.explode(F.sequence(F.lit(5).cast("long"), F.greatest("last", F.lit(5)), F.lit(37).cast("long"))).alias("row"))
    return kept.join(wanted, ["file", "row"]).select("file", "row", "o_orderkey")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '8/8/8/8/8/8/8/K6k' WHEN c_custkey % 3 = 1 THEN 'KQ6/8/8/8/8/8/8/7k' ELSE '8/8/8/3Pp3/8/8/8/kK6' END AS fen, CASE WHEN c_custkey % 3 = 0 THEN 'KvK' WHEN c_custkey % 3 = 1 THEN 'KQvK' ELSE 'KPvKP' END AS signature, (2 + c_custkey % 3)::INT AS men FROM customer")
def q118_boards(spark, sf_dir):
    """Placements written out, what they consist of and how many men."""
    k = F.col("c_custkey") % 3
    fen = F.when(k == 0, "8/8/8/8/8/8/8/K6k").when(k == 1, "KQ6/8/8/8/8/8/8/7k").otherwise("8/8/8/3Pp3/8/8/8/kK6")
    rows = table(spark, sf_dir, "customer").select("c_custkey", fen.alias("fen")).withColumn("squares", boards.expand_placement(F.col("fen")))
    men = F.length(F.regexp_replace("squares", r"\.", ""))
    return rows.select("c_custkey", "fen", boards.material_signature(F.col("squares")).alias("signature"), men.alias("men"))


@query("SELECT l_shipmode, min(l_orderkey * 100 + l_linenumber)::BIGINT AS first FROM (SELECT l_returnflag || l_linestatus AS l_shipmode, l_orderkey, l_linenumber FROM lineitem) GROUP BY 1 ORDER BY 2")
def q125_first_order(spark, sf_dir):
    """Distinct keys in the order of their first occurrence."""
    rows = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("l_shipmode"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("at"))
    return in_first_order(rows, "l_shipmode", F.col("at"))


@query("SELECT p_brand, count(DISTINCT l_orderkey) AS games, row_number() OVER (ORDER BY count(DISTINCT l_orderkey) DESC, p_brand)::INT AS place FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def q126_ranked_games(spark, sf_dir):
    """Groups by how many different games are in them."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return ranked_games(rows, "p_brand", "l_orderkey")


