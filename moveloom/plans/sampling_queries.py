"""Samples, splits, dedupes, unions and anti-joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import bands, seeded_order
from ..operators import sampling as S
from ..operators.scans import rank_rows
from ..sources.tables import table
from .registry import query


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY md5(o_orderkey::VARCHAR || ':1'), o_orderkey LIMIT 100")
def q20_hash_sample(spark, sf_dir):
    return S.sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 100, 1)


@query("""SELECT o_orderkey, o_orderpriority FROM (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(o_orderkey::VARCHAR || ':2'), o_orderkey) AS rn FROM orders)
WHERE rn <= 100 // 5 AND (SELECT min(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority)) >= 100 // 5""")
def q21_equal_shares(spark, sf_dir):
    return S.equal_shares(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 100, 2, 5)


_BAND = "CASE WHEN l_quantity >= 1 AND l_quantity < 10 THEN 'low' WHEN l_quantity >= 10 AND l_quantity < 30 THEN 'mid' WHEN l_quantity >= 30 AND l_quantity < 51 THEN 'high' ELSE 'none' END"


@query(f"""WITH r AS (SELECT l_returnflag AS family, {_BAND} AS band, l_partkey, l_orderkey * 100 + l_linenumber AS id, l_suppkey, l_shipdate FROM lineitem),
f AS (SELECT *, row_number() OVER (PARTITION BY family, band, l_partkey ORDER BY id, l_suppkey, l_shipdate) AS rn FROM r),
s AS (SELECT *, row_number() OVER (PARTITION BY family, band ORDER BY md5(l_partkey::VARCHAR || ':3'), l_partkey) AS pick FROM f WHERE rn = 1)
SELECT family, band, l_partkey FROM s WHERE pick <= 20""")
def q22_quota_cells(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("family"), bands(F.col("l_quantity"), (1, 10, 30, 51), ("low", "mid", "high")).alias("band"), "l_partkey").distinct()
    return S.quota(rows, ["family", "band"], "l_partkey", "l_partkey", 20, 3)


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i % 37 = 0 ORDER BY i LIMIT 200")
def q23_systematic_sample(spark, sf_dir):
    """Every 37th row by rank. Ranks come from counts per range of keys, so no task sees more than its range."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    placed = rank_rows(orders, [], [F.col("o_orderkey")], "n").select("o_orderkey", (F.col("n") - 1).alias("i"))
    return S.systematic(placed, F.col("i"), 37).orderBy("i").limit(200).select("o_orderkey")


@query("SELECT doc_id, (('0x' || substr(sha1(doc_id::VARCHAR), 1, 2))::INT) % 10 = 0 AS held_out FROM documents")
def q24_sha1_holdout(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.held_out(F.col("doc_id")).alias("held_out"))


_EDGES = (0, 50, 100, 150, 200, 10001)


@query("""WITH r AS (SELECT event_id, round(value - 250, 0) AS score FROM events),
b AS (SELECT *, CASE WHEN abs(score) < 50 THEN '0' WHEN abs(score) < 100 THEN '50' WHEN abs(score) < 150 THEN '100' WHEN abs(score) < 200 THEN '150' ELSE '200' END AS band, sign(score)::INT AS sign FROM r),
k AS (SELECT band, count(*) FILTER (sign > 0) AS plus, count(*) FILTER (sign < 0) AS minus FROM b GROUP BY band),
p AS (SELECT b.*, row_number() OVER (PARTITION BY band, sign ORDER BY md5(event_id::VARCHAR || ':4'), event_id) AS rn FROM b)
SELECT p.event_id, p.score, p.band, p.sign FROM p JOIN k USING (band) WHERE p.sign = 0 OR rn <= least(plus, minus)""")
def q25_sign_rebalance(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.round(F.col("value") - 250, 0).alias("score"))
    return S.sign_balance(rows, "score", "event_id", _EDGES, 4)


@query("SELECT text_key, doc_id FROM (SELECT md5(text) AS text_key, doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) AS rn FROM documents) WHERE rn = 1")
def q26_last_wins(spark, sf_dir):
    """Distinct texts, the last id of each: a max, combined map-side, on the text's hash."""
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("text_key")).agg(F.max("doc_id").alias("doc_id"))


@query("SELECT l_partkey, l_suppkey, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY ALL")
def q27_first_wins(spark, sf_dir):
    """Distinct by part of the key, the first of each."""
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min("l_orderkey").alias("l_orderkey"))


@query("""SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY md5(event_id::VARCHAR || ':5'), event_id) AS rn
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ply FROM events) WHERE ply BETWEEN 10 AND 40 AND (('0x' || substr(md5(event_id::VARCHAR || ':6'), 1, 1))::INT) < 8) WHERE rn <= 3""")
def q28_thinned_per_group(spark, sf_dir):
    """At most three of a group's plies in a window, after a fair coin each."""
    from ..operators.curves import numbered

    rows = numbered(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).where(F.col("ply").between(10, 40))
    coin = F.conv(F.substring(seeded_order(F.col("event_id"), 6), 1, 1), 16, 10).cast("int") < 8
    return S.ranked(rows.where(coin), ["user_id"], seeded_order(F.col("event_id"), 5), "event_id").where("_rank <= 3").select("user_id", "event_id")


@query("SELECT origin, copy::BIGINT AS copy, count(*) AS n FROM (SELECT 'customer' AS origin, unnest(range(1, 3)) AS copy FROM customer UNION ALL SELECT 'supplier', unnest(range(1, 2)) FROM supplier) GROUP BY ALL")
def q29_weighted_union(spark, sf_dir):
    parts = [(table(spark, sf_dir, "customer").select(F.lit("customer").alias("origin")), 2), (table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("origin")), 1)]
    return S.weighted_union(parts).groupBy("origin", "copy").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT d.doc_id, d.source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def q30_exclude(spark, sf_dir):
    """Anti-join against a test set; the same join resumes a job."""
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT source, count(*) AS n FROM documents WHERE source NOT IN (SELECT DISTINCT source FROM documents WHERE source IN ('src3', 'src7')) GROUP BY source")
def q31_quarantine(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    manifest = docs.where(F.col("source").isin("src3", "src7"))
    clean = docs.where(~F.col("source").isin("src3", "src7"))
    return S.refuse_quarantined(clean, manifest, "source").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey FROM orders WHERE ('0x' || substr(md5((o_orderkey // 500)::VARCHAR || ':7'), 1, 2))::INT < 64")
def q32_block_sample(spark, sf_dir):
    """A quarter of all blocks of 500 keys: a filter, nothing is shuffled."""
    block = F.floor(F.col("o_orderkey") / 500)
    return table(spark, sf_dir, "orders").where(F.conv(F.substring(seeded_order(block, 7), 1, 2), 16, 10).cast("int") < 64).select("o_orderkey")


@query("SELECT vec_id, rn <= 50 AS held_out FROM (SELECT vec_id, row_number() OVER (ORDER BY md5(vec_id::VARCHAR || ':8'), vec_id) AS rn FROM embeddings)")
def q33_permutation_holdout(spark, sf_dir):
    """The first 50 of a seeded permutation are held out; only those 50 are sorted."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id")
    out = S.sample(rows, "vec_id", 50, 8).withColumn("_h", F.lit(True))
    return rows.join(out, "vec_id", "left").select("vec_id", F.coalesce("_h", F.lit(False)).alias("held_out"))


@query("""WITH m AS (SELECT count(*) AS n FROM documents WHERE lang = 'en'), s AS (SELECT doc_id, lang, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || ':9'), doc_id) AS rn FROM documents WHERE lang <> 'en')
SELECT doc_id, lang FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, lang FROM s, m WHERE rn <= round_even(m.n * 0.1 / 0.9, 0)""")
def q34_ratio_mix(spark, sf_dir):
    """A side source that makes up a tenth of the mix."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    main = docs.where("lang = 'en'")
    return main.union(S.sample(docs.where("lang <> 'en'"), "doc_id", round(main.count() * 0.1 / 0.9), 9))


@query("""SELECT event_id, CASE WHEN abs(score) <= 25 THEN 'level' WHEN abs(score) < 100 THEN 'edge' ELSE 'won' END AS verdict, CASE WHEN black THEN -score ELSE score END AS own, greatest(-200.0, least(200.0, score)) AS clamped, CASE WHEN kind = 'purchase' THEN 2 WHEN kind = 'error' THEN 0 ELSE 1 END AS result
FROM (SELECT event_id, value - 250 AS score, event_type AS kind, event_id % 2 = 1 AS black FROM events) WHERE abs(score) BETWEEN 10 AND 220""")
def q35_masks_and_flips(spark, sf_dir):
    """Range masks, bands, side to move, clamping and result mapping in one pass."""
    from ..functions.scalars import clamp, from_side

    rows = table(spark, sf_dir, "events").select("event_id", (F.col("value") - 250).alias("score"), F.col("event_type").alias("kind")).where(F.abs("score").between(10, 220))
    verdict = F.when(F.abs("score") <= 25, "level").when(F.abs("score") < 100, "edge").otherwise("won")
    return rows.select("event_id", verdict.alias("verdict"), from_side(F.col("score"), F.pmod("event_id", F.lit(2)) == 1).alias("own"), clamp(F.col("score"), -200.0, 200.0).alias("clamped"),
                       F.when(F.col("kind") == "purchase", 2).when(F.col("kind") == "error", 0).otherwise(1).alias("result"))


@query("""WITH r AS (SELECT l_partkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY md5(l_orderkey::VARCHAR || ':10'), l_orderkey, l_linenumber) AS rn FROM lineitem WHERE l_quantity >= 20)
SELECT l_partkey, l_orderkey FROM r WHERE rn = 1 ORDER BY md5(l_orderkey::VARCHAR || ':10'), l_orderkey, l_partkey LIMIT 150""")
def q36_distinct_structure(spark, sf_dir):
    """One row per structure, taken in a seeded order among accepted rows, then the first 150."""
    rows = table(spark, sf_dir, "lineitem").where("l_quantity >= 20").select("l_partkey", "l_orderkey", "l_linenumber")
    best = rows.groupBy("l_partkey").agg(F.min(F.struct(seeded_order(F.col("l_orderkey"), 10).alias("h"), "l_orderkey", "l_linenumber")).alias("b"))
    return best.orderBy("b.h", "b.l_orderkey", "l_partkey").limit(150).select("l_partkey", F.col("b.l_orderkey").alias("l_orderkey"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND lower(c_name) LIKE '%00%' AND c_nationkey BETWEEN 5 AND 15")
def q37_header_predicates(spark, sf_dir):
    return table(spark, sf_dir, "customer").where((F.col("c_mktsegment") == "BUILDING") & F.lower("c_name").contains("00") & F.col("c_nationkey").between(5, 15)).select("c_custkey", "c_name")


@query("SELECT c.c_custkey, coalesce(s.s_acctbal, c.c_acctbal) AS acctbal, s.s_suppkey IS NOT NULL AS renewed FROM customer c LEFT JOIN supplier s ON s.s_suppkey = c.c_custkey")
def q38_relabel(spark, sf_dir):
    """New labels where there are any, the old ones elsewhere."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return c.join(s, c.c_custkey == s.s_suppkey, "left").select("c_custkey", F.coalesce("s_acctbal", "c_acctbal").alias("acctbal"), F.col("s_suppkey").isNotNull().alias("renewed"))


@query("SELECT coalesce(s.s_suppkey, c.c_custkey) AS key, coalesce(s.s_name, c.c_name) AS name FROM supplier s FULL JOIN customer c ON s.s_suppkey = c.c_custkey")
def q39_upsert(spark, sf_dir):
    """A merge that keeps what exists."""
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    return s.join(c, s.s_suppkey == c.c_custkey, "full").select(F.coalesce("s_suppkey", "c_custkey").alias("key"), F.coalesce("s_name", "c_name").alias("name"))


@query("""SELECT CASE WHEN abs(score) < 50 THEN '0' WHEN abs(score) < 100 THEN '50' WHEN abs(score) < 150 THEN '100' WHEN abs(score) < 200 THEN '150' ELSE '200' END AS band,
(count(*) FILTER (score > 0))::BIGINT AS plus, (count(*) FILTER (score < 0))::BIGINT AS minus, (count(*) FILTER (score = 0))::BIGINT AS level, 2 * least(count(*) FILTER (score > 0), count(*) FILTER (score < 0))::BIGINT AS taken
FROM (SELECT round(value - 35, 0) AS score FROM events) GROUP BY 1""")
def q135_band_report(spark, sf_dir):
    """Rows per band and sign, and how many a balanced sample takes of them."""
    rows = table(spark, sf_dir, "events").select(F.round(F.col("value") - 35, 0).alias("score"))
    band = bands(F.abs("score"), (0, 50, 100, 150, 200), ("0", "50", "100", "150"), "200")
    n = lambda c: F.sum(c.cast("long"))
    out = rows.groupBy(band.alias("band")).agg(n(F.col("score") > 0).alias("plus"), n(F.col("score") < 0).alias("minus"), n(F.col("score") == 0).alias("level"))
    return out.withColumn("taken", 2 * F.least("plus", "minus"))


@query("""WITH a AS (SELECT o_custkey AS k, avg(o_totalprice) AS x FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1), b AS (SELECT o_custkey AS k, avg(o_totalprice) AS y FROM orders WHERE o_orderpriority = '2-HIGH' GROUP BY 1)
SELECT count(*) AS shared, (count(*) FILTER (abs(x - y) < 50000))::BIGINT AS agree, round(avg(x - y), 3) AS mean, round(stddev_samp(x - y), 3) AS spread FROM a JOIN b ON a.k = b.k""")
def q137_paired_runs(spark, sf_dir):
    """Two runs compared on the keys they share."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderpriority", "o_totalprice")
    one, two = (orders.where(F.col("o_orderpriority") == p).groupBy("k").agg(F.avg("o_totalprice").alias(n)) for p, n in (("1-URGENT", "x"), ("2-HIGH", "y")))
    d = F.col("x") - F.col("y")
    return one.join(two, "k").agg(F.count(F.lit(1)).alias("shared"), F.sum((F.abs(d) < 50000).cast("long")).alias("agree"), F.round(F.avg(d), 3).alias("mean"), F.round(F.stddev_samp(d), 3).alias("spread"))


@query("SELECT lang, quality, toxic, count(*) AS n, round(avg(n_chars), 4) AS chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY ALL")
def q139_labels_of_rows(spark, sf_dir):
    """Labels joined to what they are about."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return rows.groupBy("lang", "quality", "toxic").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 4).alias("chars"))
