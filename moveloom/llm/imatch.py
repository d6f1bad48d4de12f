r"""Document fingerprints by I-Match (operator 4), in DataFrame functions only.

Terms are lower-cased runs of letters and digits. Of these, the lexicon keeps those within a band of
inverse document frequency: in at most MAX_SHARE of all distinct texts, so that a group of copies, however
large, weighs once; and in at least two documents and in MIN_SHARE of them. Near copies are distinct texts
and weigh each. Document frequencies add up to the number of (document, term) pairs, so the lexicon has at
most 1 / MIN_SHARE times as many terms as a document has distinct ones on average. It is broadcast if it has
no more than BROADCAST_TERMS, and else joined by term, a term's rows dealt to many tasks; both give the same.

A fingerprint has LEVELS x PARTS signatures. Each is the hash of the document's sorted distinct terms in one
random subset of the lexicon, chosen by bits of the term's hash; the subsets of a level take one in 16, 64,
256, 1024 of all terms, so small changes are told from large ones in long and in short documents. The
likeness of two fingerprints is the share of equal signatures among the subsets that either touches.
A document without any lexicon term has its text's hash instead, which is like itself only.

The edited text takes its second half from the next document by descending id. Documents are dealt by
ranges of ids, the last of each range a second time to the range below it, so that whole texts are
shuffled once and every window runs within a range.

Defined cases: a null text is an empty one; equal ids are ordered by their texts, null ids come last;
a single document is its own next; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, free_shuffles, prefix_sums, with_group

MAX_SHARE = 0.25
MIN_SHARE = 0.0002
#: Terms (of eight bytes) that are broadcast as a table, or sent as a list with each text.
BROADCAST_TERMS = 1_000_000
LISTED_TERMS = 2_000
LEVELS = (16, 64, 256, 1024)
PARTS = 8
#: Documents per range of ids. Ranges become longer where there would be more than MAX_RANGES, as their bounds go to
#: all tasks; a range is sorted on disk if need be.
RANGE_ROWS = 500
MAX_RANGES = 1 << 18
_STEP = 64


def term_ids(text: Column) -> Column:
    """Hashes of the distinct terms of a text; even numbers, so that the lowest bit is free."""
    terms = F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), "")
    return F.transform(terms, lambda t: F.xxhash64(t).bitwiseAND(F.lit(-2)))


def lexicon(spark: SparkSession, docs: DataFrame, n_docs: int) -> DataFrame:
    """(term) within the band, over all documents, written down.

    A term in few rows is in few texts. Only those in many rows are counted by distinct texts, from what each text has of them.
    """
    scratch = Scratch(spark)
    found = docs.select(F.explode_outer(term_ids(F.col("text"))).alias("term"))  # explode() would compute the array twice, to filter
    counted = found.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where("term is not null")
    counted = scratch.keep(counted.where(F.col("df") >= max(2.0, MIN_SHARE * n_docs)))
    n_texts = docs.select(F.md5("text")).distinct().count()
    most = max(2.0, MAX_SHARE * n_texts)
    rare, often = counted.where(F.col("df") <= most).select("term"), counted.where(F.col("df") > most).select("term")
    if n_texts == n_docs:
        return scratch.keep(rare)
    hashed = docs.select(F.md5("text").alias("hash"), term_ids(F.col("text")).alias("terms"))
    first = often.limit(LISTED_TERMS + 1).collect()
    if len(first) <= LISTED_TERMS:
        held = hashed.select("hash", F.array_intersect("terms", F.array(*(F.lit(r.term) for r in first)).cast("array<long>")).alias("held"))
        single = held.groupBy("hash").agg(F.first("held").alias("held")).select(F.explode_outer("held").alias("term"))
    else:
        found = hashed.select("hash", F.explode_outer("terms").alias("found"))
        single = with_group(found, often, "found", "term", "inner", BROADCAST_TERMS).select("hash", F.col("found").alias("term")).distinct()
    in_texts = single.groupBy("term").agg(F.count(F.lit(1)).alias("texts")).where((F.col("texts") <= most) & F.col("term").isNotNull())
    out = scratch.keep(rare.union(in_texts.select("term")))
    free_shuffles(spark)
    return out


def signatures(terms: Column) -> Column:
    """LEVELS x PARTS hashes of sorted distinct terms by subset, null where a subset has none of them."""
    return F.concat(*(_level(terms, 1 + 12 * k, takes) for k, takes in enumerate(LEVELS)))


def _level(terms: Column, shift: int, takes: int) -> Column:
    def place(t: Column) -> Column:
        return F.shiftrightunsigned(t, shift).bitwiseAND(F.lit(takes - 1))

    own = F.filter(terms, lambda t: place(t) < PARTS)

    def signature(k: Column) -> Column:
        part = F.filter(own, lambda t: place(t) == k)
        return F.when(F.size(part) > 0, F.xxhash64(part).bitwiseAND(F.lit(0xFFFFFFFF)))

    return F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), signature)


def fingerprint(signature: Column, text_hash: Column) -> Column:
    shown = F.array_join(F.transform(signature, lambda s: F.coalesce(F.lower(F.hex(s)), F.lit("-"))), " ")
    return F.when(F.exists(signature, lambda s: s.isNotNull()), shown).otherwise(F.concat(F.lit("text "), text_hash))


def likeness(a: Column, b: Column, print_a: Column, print_b: Column) -> Column:
    pairs = F.filter(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: p["x"].isNotNull() | p["y"].isNotNull())
    equal = F.filter(pairs, lambda p: p["x"].eqNullSafe(p["y"]))
    return F.when(print_a == print_b, 1.0).when(F.size(pairs) > 0, F.size(equal) / F.size(pairs)).otherwise(0.0)


def _ranged(docs: DataFrame, n_docs: int) -> Column:
    """The column that numbers the range of a row's id, upwards; null ids are in range -1.

    Ids are sorted and numbered, and every so manieth becomes a bound. A bound is looked up in every
    _STEP**k-th of them, then between two of these in every _STEP**(k-1)-th, and so on.
    """
    rows = max(RANGE_ROWS, -(-n_docs // MAX_RANGES))
    ids, bounds = F.col("doc_id"), []
    if n_docs > rows:
        numbered = prefix_sums(Scratch(docs.sparkSession), docs.select("doc_id").where(ids.isNotNull()), [ids.asc()], {"number": F.lit(1).cast("long")})
        bounds = sorted({r.doc_id for r in numbered.where((F.col("number") + 1) % rows == 0).select("doc_id").collect()})
    place = F.lit(0)
    step = 1
    while step * _STEP < len(bounds):
        step *= _STEP
    top = True
    while step and bounds:
        kept = bounds[::step]
        if isinstance(bounds[0], int):  # one literal
            known = F.split(F.lit(",".join(map(str, kept))), ",").cast(f"array<{docs.schema['doc_id'].dataType.simpleString()}>")
        else:
            known = F.array(*map(F.lit, kept))
        start = F.lit(0) if top else F.greatest(place - 1, F.lit(0)) * _STEP
        near = known if top else F.slice(known, start + 1, F.lit(_STEP))
        place, step, top = start + F.size(F.filter(near, lambda b: b < ids)), step // _STEP, False
    return F.when(ids.isNull(), -1).otherwise(place)


def fingerprint_edits(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n_docs = docs.count()
    terms = lexicon(spark, docs, n_docs).union(spark.range(1).select(F.lit(0).cast("long").alias("term")))  # 0 stands in every document

    at = _ranged(docs, n_docs)
    tops = docs.select("doc_id", at.alias("range")).groupBy("range").agg(F.max("doc_id").alias("top")).orderBy("range").collect()
    followers = [(tops[k - 1].top, r.range) for k, r in enumerate(tops)]  # the lowest range goes on with the highest
    below = spark.createDataFrame(followers, f"top {docs.schema['doc_id'].dataType.simpleString()}, range int")
    again = docs.join(F.broadcast(below), F.col("doc_id").eqNullSafe(F.col("top"))).select("doc_id", "text", "range", F.lit(1).alias("again"))
    dealt = docs.select("doc_id", "text", at.cast("int").alias("range"), F.lit(0).alias("again")).union(again).repartition("range")
    order = Window.partitionBy("range").orderBy("again", F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    with_next = dealt.withColumn("place", F.row_number().over(order)).withColumn("after", F.coalesce(F.lead("text").over(order), F.lit("")))

    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.substring(F.col("after"), F.lit(1), half))
    made = with_next.select("range", "place", "again", "doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"), "text", edited.alias("edited"))
    made = made.select("range", "place", "again", "doc_id", "n_chars", "text_md5", F.md5("edited").alias("edited_md5"), F.sha2("edited", 256).alias("edited_sha256"),
                       F.concat(F.array(F.lit(0).cast("long")), term_ids(F.col("text")), F.transform(term_ids(F.col("edited")), lambda t: t.bitwiseOR(F.lit(1)))).alias("terms"))
    keys = ["range", "place", "again", "doc_id", "n_chars", "text_md5", "edited_md5", "edited_sha256"]
    single = made.select(*keys, F.explode_outer("terms").alias("found"))
    known = with_group(single.withColumn("wanted", F.col("found").bitwiseAND(F.lit(-2))), terms, "wanted", "term", "inner", BROADCAST_TERMS).withColumnRenamed("wanted", "term")
    of = lambda bit: F.array_sort(F.collect_list(F.when((F.col("found").bitwiseAND(F.lit(1)) == bit) & (F.col("term") != 0), F.col("term"))))
    rows = known.groupBy("range", "place").agg(*(F.first(k).alias(k) for k in keys[2:]), of(0).alias("own"), of(1).alias("other"))
    rows = rows.select(*keys, signatures(F.col("own")).alias("own"), signatures(F.col("other")).alias("other"))
    rows = rows.withColumn("fingerprint", fingerprint(F.col("own"), F.col("text_md5"))).withColumn("edited_fingerprint", fingerprint(F.col("other"), F.col("edited_md5")))
    onward = Window.partitionBy("range").orderBy("place")
    rows = rows.withColumn("next", F.lead(F.struct("own", "fingerprint")).over(onward)).where("again = 0")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                       likeness(F.col("own"), F.col("other"), F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                       likeness(F.col("own"), F.col("next.own"), F.col("fingerprint"), F.col("next.fingerprint")).alias("near_next"))
