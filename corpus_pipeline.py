"""A corpus pipeline of five stages: quality, near duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as
the next one's docs. All but the last keep the columns of documents; the last returns packed pieces.

Defined cases, for all stages: extra columns pass through the first four, whatever their names; an empty table gives
an empty one; long texts are worked on whole; rows are known by id and text together, never by id alone, and null ids
are ids like any other. Null texts: quality rules reject them (they have no words), as they do empty and short ones;
should a later stage meet one, it resembles nothing and stays, has nothing to mask, has size 0 in the mix and packs as
one end id. Null hosts and sources: judged by the document alone; a source of their own, last in order. Repeated rows:
equal in id and text, one of them stays; equal in text only, the one with the smallest id; mixing repeats rows, and
packing packs each. Ties: of rows with equal ids that resemble each other the one with the smaller hash stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moveloom.llm import mixing, ngram_join, packing, pii, quality
from moveloom.llm.queries import tokenizer_file
from moveloom.llm.shared import Scratch, free_shuffles, fresh, load, ship

#: Near duplicates of the pipeline: sets of five-word shingles, similarity of 0.8 or more.
SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    ship(spark)
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id, once; null ids come last, texts of one id by hash.

    A row is known by a hash of its id and text, so several rows may have one id or none.
    """
    ship(spark)
    key = fresh(docs, "_row")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    classes = ngram_join.join_classes(spark, keyed.select(F.col(key).alias("doc_id"), "text"), SHINGLE_WORDS, SIMILAR_PERCENT)
    rows = classes.groupBy(F.col("doc_id").alias(key)).agg(F.first("component_id").alias("component"), F.count(F.lit(1)).alias("n"))
    ids = keyed.select(key, F.col("doc_id").alias("id")).distinct()
    scratch = Scratch(spark)
    members = scratch.keep(rows.join(ids, key))
    del classes, rows
    free_shuffles(spark)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", key)).alias("first")
    groups = scratch.keep(members.groupBy("component").agg(first, F.count(F.lit(1)).alias("size")).where("size > 1").select("component", F.col(f"first.{key}").alias("stays")))
    gone = scratch.keep(members.join(groups, "component").where(F.col(key) != F.col("stays")).select(key))
    free_shuffles(spark)
    kept = keyed.join(gone, key, "left_anti")  # what goes is a small part of what stays, so texts are shuffled only where even that is too much to broadcast
    if members.where("n > 1").limit(1).count():  # rows equal in id and text
        kept = kept.dropDuplicates([key])
    return kept.select(docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    ship(spark)
    masked = pii.redact(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return masked


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target size asks for."""
    return mixing.mix_sources(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset."""
    ship(spark)
    return packing.pack(spark, docs, tokenizer_file())


STAGES = [
    ("quality_rules", drop_low_quality),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("mixing", mix),
    ("best_fit_packing", pack),
]

#: Packing is a heuristic that SQL can't state; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    scratch = Scratch(spark)
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
