"""Arrays, bits, multi-label counts and report cubes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import bands, ending_label, floor_div, half_even, highest_bit, lowest_bit, merged_maps, output_bucket, position_key, truncated, tsv_cell
from ..sources.tables import games, table
from .registry import GAMES, query


@query("""WITH s AS (SELECT label AS phase, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS square FROM embeddings),
h AS (SELECT phase, square, count(*) AS n, sum(CASE WHEN v > 0 THEN 1.0 WHEN v = 0 THEN 0.5 ELSE 0.0 END) AS points FROM s GROUP BY ALL),
w AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY phase) AS share, points / n - sum(points) OVER (PARTITION BY phase) / sum(n) OVER (PARTITION BY phase) AS edge FROM h)
SELECT phase, square::BIGINT AS square, n, round(share, 5) AS share, round(CASE WHEN n >= 40 THEN edge ELSE 0 END, 4) AS edge FROM w""")
def q75_heatmap(spark, sf_dir):
    """Counts, shares and edge over the group's mean per square; thin squares have no edge."""
    s = table(spark, sf_dir, "embeddings").select(F.col("label").alias("phase"), F.posexplode("embedding").alias("square", "v"))
    points = F.when(F.col("v") > 0, 1.0).when(F.col("v") == 0, 0.5).otherwise(0.0)
    h = s.groupBy("phase", F.col("square").cast("long").alias("square")).agg(F.count(F.lit(1)).alias("n"), F.sum(points).alias("points"))
    w = Window.partitionBy("phase")
    edge = F.col("points") / F.col("n") - F.sum("points").over(w) / F.sum("n").over(w)
    return h.select("phase", "square", "n", F.round(F.col("n") / F.sum("n").over(w), 5).alias("share"), F.round(F.when(F.col("n") >= 40, edge).otherwise(0.0), 4).alias("edge"))


@query("""WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: round_even(x::DOUBLE * 100, 0)::BIGINT) AS e FROM embeddings),
s AS (SELECT vec_id, list_sum(list_transform(e, lambda x: greatest(0, least(255, x)) * 3))::BIGINT AS clipped, list_sum(list_transform(e, lambda x: greatest(0, least(255, x)) * greatest(0, least(255, x))))::BIGINT AS squared FROM q)
SELECT vec_id, clipped, squared, (sign(clipped - squared) * floor(abs(clipped - squared) / 64.0))::BIGINT AS output FROM s""")
def q76_clipped_dot(spark, sf_dir):
    """A quantised layer: clipped and squared-clipped sums, divided towards zero."""
    e = F.transform("embedding", lambda x: F.rint(x.cast("double") * 100).cast("long"))
    clip = lambda x: F.greatest(F.lit(0).cast("long"), F.least(F.lit(255).cast("long"), x))
    total = lambda f: F.aggregate("e", F.lit(0).cast("long"), lambda acc, x: acc + f(x))
    s = table(spark, sf_dir, "embeddings").select("vec_id", e.alias("e")).select("vec_id", total(lambda x: clip(x) * 3).alias("clipped"), total(lambda x: clip(x) * clip(x)).alias("squared"))
    return s.select("vec_id", "clipped", "squared", truncated(F.col("clipped") - F.col("squared"), 64.0).alias("output"))


_TAGS = "list_filter([CASE WHEN l_discount >= 0.05 THEN 'cheap' END, CASE WHEN l_quantity >= 30 THEN 'large' END, CASE WHEN l_returnflag = 'R' THEN 'back' END], lambda x: x IS NOT NULL)"


def tagged(spark, sf_dir):
    tags = F.array_compact(F.array(F.when(F.col("l_discount") >= 0.05, "cheap"), F.when(F.col("l_quantity") >= 30, "large"), F.when(F.col("l_returnflag") == "R", "back")))
    return table(spark, sf_dir, "lineitem").select(tags.alias("tags"))


@query(f"WITH t AS (SELECT {_TAGS} AS tags FROM lineitem) SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM t UNION ALL SELECT 'all' FROM t) GROUP BY tag")
def q77_multi_label(spark, sf_dir):
    return tagged(spark, sf_dir).select(F.explode(F.concat("tags", F.array(F.lit("all")))).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT array_to_string({_TAGS}, ' + ') AS combination, count(*) AS n FROM lineitem GROUP BY 1")
def q78_combinations(spark, sf_dir):
    return tagged(spark, sf_dir).groupBy(F.array_join("tags", " + ").alias("combination")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_returnflag, l_linestatus, l_linenumber, grouping(l_returnflag, l_linestatus, l_linenumber)::BIGINT AS level, count(*) AS n, round(sum(l_discount * l_extendedprice), 2) AS loss
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_linenumber), (l_returnflag, l_linestatus), ())""")
def q79_grouping_sets(spark, sf_dir):
    """Losses by each dimension of a report in one pass."""
    return spark.sql("""SELECT l_returnflag, l_linestatus, l_linenumber, grouping_id(l_returnflag, l_linestatus, l_linenumber) AS level, count(*) AS n, round(sum(l_discount * l_extendedprice), 2) AS loss
      FROM {lines} GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_linenumber), (l_returnflag, l_linestatus), ())""", lines=table(spark, sf_dir, "lineitem"))


@query("""WITH b AS (SELECT vec_id, list_reduce(list_transform(range(0, 63), lambda i: CASE WHEN embedding[i + 1] > 0 THEN (1::BIGINT << i::INT) ELSE 0::BIGINT END), lambda x, y: x + y) + CASE WHEN embedding[64] > 0 THEN (-9223372036854775808)::BIGINT ELSE 0::BIGINT END AS bits FROM embeddings)
SELECT vec_id, bits, bit_count(bits)::INT AS men, xor(bits, 56::BIGINT) AS flipped, (bits >> 8) & 255 AS rank2 FROM b""")
def q80_bitboards(spark, sf_dir):
    """Signs packed into one word: population count, flips and masks."""
    bits = F.expr("aggregate(sequence(0, 63), 0L, (acc, i) -> acc | IF(embedding[i] > 0, shiftleft(1L, i), 0L))")
    b = table(spark, sf_dir, "embeddings").select("vec_id", bits.alias("bits"))
    return b.select("vec_id", "bits", F.bit_count("bits").alias("men"), F.col("bits").bitwiseXOR(F.lit(56).cast("long")).alias("flipped"), F.shiftright("bits", 8).bitwiseAND(F.lit(255).cast("long")).alias("rank2"))


@query("SELECT l_linenumber, l_quantity::BIGINT AS q, CASE WHEN l_quantity >= 26 THEN 'opening' WHEN l_quantity >= 14 THEN 'middle' ELSE 'ending' END AS phase, greatest(0, least(7, floor((l_quantity - 2) / 4)))::INT AS bucket, (sign(l_linenumber - 3) * greatest(400, least(900, 900 - 10 * l_quantity)))::BIGINT AS label, count(*) AS n FROM lineitem GROUP BY ALL")
def q81_phases(spark, sf_dir):
    """Phase by men, output bucket and the label of a decided ending."""
    q = F.col("l_quantity")
    phase = F.when(q >= 26, "opening").when(q >= 14, "middle").otherwise("ending")
    return table(spark, sf_dir, "lineitem").groupBy("l_linenumber", q.cast("long").alias("q"), phase.alias("phase"), output_bucket(q).alias("bucket"), ending_label(F.col("l_linenumber") - 3, q).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, round_even(value / 2, 0) AS half, floor((value - 250) / 24)::BIGINT AS floored, trunc((value - 250) / 24)::BIGINT AS cut, (('0x' || substr(md5(event_id::VARCHAR), 1, 6))::BIGINT) % 64 AS square FROM events")
def q82_rounding(spark, sf_dir):
    """Half-even, floor and truncating division side by side."""
    x = F.col("value") - 250
    square = F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 6), 16, 10).cast("long") % 64
    return table(spark, sf_dir, "events").select("event_id", F.rint(F.col("value") / 2).alias("half"), floor_div(x, 24).alias("floored"), (F.signum(x) * F.floor(F.abs(x) / 24)).cast("long").alias("cut"), square.alias("square"))


@query(f"WITH {GAMES} SELECT game, array_to_string(list_transform(list_sort(list_distinct(moves)), lambda m: m || len(list_filter(moves, lambda x: x = m))::VARCHAR), ' ') AS signature FROM g")
def q83_signature(spark, sf_dir):
    """What a game consists of, as a sorted signature with counts."""
    kinds = F.array_sort(F.array_distinct("moves"))
    part = lambda m: F.concat(m, F.size(F.filter("moves", lambda x: x == m)).cast("string"))
    return games(spark, sf_dir).select("game", F.array_join(F.transform(kinds, part), " ").alias("signature"))


@query("""WITH s AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), t AS (SELECT label, i, sum(CASE WHEN v > 0 THEN 1 ELSE 0 END)::BIGINT AS n FROM s GROUP BY ALL)
SELECT label, i::BIGINT AS i, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY label), 6) AS share FROM t""")
def q84_vector_sum(spark, sf_dir):
    """Element-wise sums of counters, and their shares."""
    s = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("at", "v"))
    t = s.groupBy("label", (F.col("at") + 1).cast("long").alias("i")).agg(F.sum((F.col("v") > 0).cast("long")).alias("n"))
    return t.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("label")), 6))


@query("SELECT l_orderkey % 7 AS family, CASE WHEN l_quantity >= 1 AND l_quantity < 10 THEN 'low' WHEN l_quantity >= 10 AND l_quantity < 30 THEN 'mid' ELSE 'none' END AS band, count(*) AS n, count(DISTINCT l_orderkey) AS games FROM lineitem GROUP BY ALL")
def q85_bands_and_games(spark, sf_dir):
    """Rows and distinct games per group."""
    band = bands(F.col("l_quantity"), (1, 10, 30), ("low", "mid"))
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 7).alias("family"), band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_orderkey").alias("games"))


@query("SELECT doc_id, array_to_string(string_split(text, ' ')[1:4], ' ') AS key, translate(text, chr(9) || chr(10) || chr(13), '   ') AS cell FROM documents")
def q86_text_keys(spark, sf_dir):
    """Keys of the first four fields, and whole texts as cells fit for a TSV file."""
    return table(spark, sf_dir, "documents").select("doc_id", position_key(F.col("text")).alias("key"), tsv_cell(F.col("text")).alias("cell"))


@query("""WITH r AS (SELECT source, n_chars, doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS rn, count(*) OVER () AS n FROM documents) SELECT rn <= greatest(10, n // 5) AS worst, count(*) AS n, round(avg(n_chars), 4) AS mean FROM r GROUP BY 1""")
def q87_worst_fifth(spark, sf_dir):
    """The worst fifth against the rest, from the counts per value: rows of one value are alike here, so no row is ranked."""
    docs = table(spark, sf_dir, "documents").select("n_chars")
    cut = max(10, docs.count() // 5)
    per_size = docs.groupBy("n_chars").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy(F.col("n_chars").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    worst = per_size.select("n_chars", "n", F.greatest(F.lit(0), F.least(F.col("n"), cut - before)).alias("in"))
    sides = worst.select("n_chars", F.explode(F.array(F.struct(F.lit(True).alias("worst"), F.col("in").alias("n")), F.struct(F.lit(False).alias("worst"), (F.col("n") - F.col("in")).alias("n")))).alias("x"))
    return sides.where("x.n > 0").groupBy("x.worst").agg(F.sum("x.n").alias("n"), F.round(F.sum(F.col("n_chars") * F.col("x.n")) / F.sum("x.n"), 4).alias("mean"))


@query("SELECT label, round(avg(round_even(value, 1)), 4) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS value FROM embeddings) GROUP BY label")
def q88_half_even_mean(spark, sf_dir):
    s = table(spark, sf_dir, "embeddings").select("label", F.explode("embedding").alias("v"))
    return s.groupBy("label").agg(F.round(F.avg(half_even(F.col("v").cast("double"), 1)), 4).alias("mean"))


@query("""WITH b AS (SELECT event_id, (('0x' || substr(md5(event_id::VARCHAR), 1, 15))::BIGINT) | 1 AS bits FROM events)
SELECT event_id, bits, bit_count(bits)::INT AS n, (bit_count(((bits & -4) & -(bits & -4)) - 1))::INT AS second, (length(ltrim(bits::BIT::VARCHAR, '0')) - 1)::INT AS highest, xor(bits, 7::BIGINT) & 63 AS mirrored FROM b WHERE bits & -4 <> 0""")
def q130_bit_places(spark, sf_dir):
    """Lowest and highest set bits of masked words, and flips of a square's number."""
    bits = F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 15), 16, 10).cast("long").bitwiseOR(F.lit(1).cast("long"))
    b = table(spark, sf_dir, "events").select("event_id", bits.alias("bits")).withColumn("rest", F.col("bits").bitwiseAND(F.lit(-4).cast("long"))).where("rest <> 0")
    return b.select("event_id", "bits", F.bit_count("bits").alias("n"), lowest_bit(F.col("rest")).alias("second"), highest_bit(F.col("bits")).alias("highest"), F.col("bits").bitwiseXOR(F.lit(7).cast("long")).bitwiseAND(F.lit(63).cast("long")).alias("mirrored"))


@query("""SELECT event_id, strftime(ts, '%Y.%m.%d') AS day, (epoch_us(ts) // 1000)::BIGINT AS ms, epoch_ms(strptime(strftime(ts, '%Y.%m.%d %H:%M'), '%Y.%m.%d %H:%M'))::BIGINT AS minute FROM events""")
def q131_dates(spark, sf_dir):
    """Times written, read again and as milliseconds."""
    ts = F.col("ts").cast("timestamp")
    minute = F.to_timestamp(F.date_format(ts, "yyyy.MM.dd HH:mm"), "yyyy.MM.dd HH:mm")
    return table(spark, sf_dir, "events").select("event_id", F.date_format(ts, "yyyy.MM.dd").alias("day"), F.unix_millis(ts).alias("ms"), F.unix_millis(minute).alias("minute"))


@query("""SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS best, array_to_string(list_transform(list_grade_up(embedding)[1:3], lambda i: (i - 1)::INT), ',') AS lowest, len(list_filter(embedding, lambda x: x > 0))::INT AS positive,
len(list_filter(embedding, lambda x: x > 100)) > 0 AS any_large, len(list_filter(embedding, lambda x: x < 100)) = len(embedding) AS all_small, list_contains([1, 3, 5], label) AS odd FROM embeddings""")
def q132_array_numeric(spark, sf_dir):
    """Place of the largest value, stable order, any, all, and membership in a list."""
    e, at = F.col("embedding"), F.transform("embedding", lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", (F.array_position(e, F.array_max(e)) - 1).cast("int").alias("best"), F.array_join(F.transform(F.slice(F.array_sort(at), 1, 3), lambda p: p["i"].cast("string")), ",").alias("lowest"),
        F.size(F.filter(e, lambda x: x > 0)).alias("positive"), F.exists(e, lambda x: x > 100).alias("any_large"), F.forall(e, lambda x: x < 100).alias("all_small"), F.col("label").isin(1, 3, 5).alias("odd"))


@query("""WITH m AS (SELECT user_id, max(CASE WHEN event_type = 'click' THEN value END) AS click, max(CASE WHEN event_type = 'view' THEN value END) AS view, count(*) AS n FROM events GROUP BY user_id)
SELECT user_id, coalesce(click, -1.0) AS click, coalesce(view, click, -2.0) AS view, n AS total FROM m""")
def q133_map_merge(spark, sf_dir):
    """Maps merged with later ones winning: defaults, then what is known."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("v"), F.count(F.lit(1)).alias("n"))
    known = rows.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("known"), F.sum("n").alias("total"))
    defaults = F.create_map(F.lit("click"), F.lit(-1.0), F.lit("view"), F.coalesce(F.try_element_at("known", F.lit("click")), F.lit(-2.0)))
    merged = merged_maps(defaults, F.col("known"))
    return known.select("user_id", F.element_at(merged, "click").alias("click"), F.element_at(merged, "view").alias("view"), "total")


@query("SELECT p_partkey, trim(regexp_split_to_array(p_name || ', by ' || p_brand || ' (old)', '[,(]| by ')[1]) AS head, len(list_filter(list_transform(regexp_split_to_array(p_name || ', by ' || p_brand || ' (old)', '[,(]| by '), lambda x: trim(x)), lambda x: x <> ''))::INT AS parts FROM part")
def q134_cut_at_several(spark, sf_dir):
    """A text cut at the first of several separators, and its parts."""
    text = F.concat("p_name", F.lit(", by "), "p_brand", F.lit(" (old)"))
    parts = F.transform(F.split(text, r"[,(]| by "), F.trim)
    return table(spark, sf_dir, "part").select("p_partkey", F.get(parts, F.lit(0)).alias("head"), F.size(F.filter(parts, lambda x: x != "")).alias("parts"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, trunc((m * phase + e * (24 - phase)) / 24)::BIGINT AS value FROM (SELECT *, l_quantity::BIGINT * 10 - 250 AS m, l_linenumber * 20 - 80 AS e, least(24, l_partkey % 30) AS phase FROM lineitem)")
def q138_tapered(spark, sf_dir):
    """Two values blended by phase, divided towards zero."""
    m, e, phase = F.col("l_quantity").cast("long") * 10 - 250, F.col("l_linenumber") * 20 - 80, F.least(F.lit(24), F.col("l_partkey") % 30)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", truncated(m * phase + e * (24 - phase), 24.0).alias("value"))
