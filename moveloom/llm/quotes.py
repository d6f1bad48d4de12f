r"""Chat formatting by quotation linking (operator 3), in DataFrame functions only.

A line's quote level is the number of `>` before it. Passages (runs of lines of one level between blank
lines) and single lines are normalised (lower case, white space collapsed) and hashed; each quoted one is
linked to the last earlier message of its conversation that has it unquoted. The link of the lowest level
decides, then the longest text, then the latest source; a message without any link answers the message
before it. Quoted lines and the line that announces them are removed.

Conversations come out in reply order: a message, then what follows it directly, then the branches that
answer it, those of deeper messages first. A message that answers the one right before it stays in that
message's chain; any other starts a branch. Only branches are resolved along the tree, by doubling, and a
message's place is `reply_path`: for each branch on the way (1, -turn answered, turn it starts), and last
(0, turn, 0); rows sort by conversation and path. No conversation and no passage of one is gathered in one
task: what comes last before a message is looked for in blocks of turns, between blocks in blocks of blocks,
and the order is a sort key. (Branches that answer branches make the paths long, as each says its whole way.)

Defined cases: a null text is empty; rows without a conversation or turn stay alone, without parent; rows
of equal conversation and turn count as one message for links and share a place; repeated rows repeat; an
empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, fresh

#: Turns per block, and blocks per block of blocks, in which what comes before a message is looked for.
BLOCK_TURNS = 256
_MARKS = r"^(?:[ \t]*>)+"
_ANNOUNCES = r"(?i)\b(?:wrote|writes|schrieb|écrit|escribió)\s*:\s*$"


def level_of(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 0), "[^>]", ""))


def body_of(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, _MARKS, ""))


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def without_quotes(text: Column) -> Column:
    """The lines of level 0, without a line that announces the quote after it."""
    lines = F.split(text, "\n")
    later = F.concat(F.slice(lines, F.lit(2), F.size(lines)), F.array(F.lit("")))
    kept = F.filter(F.arrays_zip(lines.alias("own"), later.alias("next")),
                    lambda p: (level_of(p["own"]) == 0) & ~(p["own"].rlike(_ANNOUNCES) & (level_of(p["next"]) > 0)))
    return F.trim(F.array_join(F.transform(kept, lambda p: p["own"]), "\n"))


def _passages(messages: DataFrame) -> DataFrame:
    """(conv, turn, level, hash, length) of all passages and lines, once per message."""
    lines = messages.select("conv", "turn", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.select("conv", "turn", "at", level_of(F.col("line")).alias("level"), normal(body_of(F.col("line"))).alias("body")).where("body <> ''")
    order = Window.partitionBy("conv", "turn", "level").orderBy("at")
    runs = lines.withColumn("run", F.col("at") - F.row_number().over(order))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "body"))), lambda x: x["body"]), " ")
    passages = runs.groupBy("conv", "turn", "level", "run").agg(text.alias("body")).drop("run")
    units = passages.union(lines.select("conv", "turn", "level", "body"))
    return units.select("conv", "turn", "level", F.xxhash64("body").alias("hash"), F.length("body").alias("length")).distinct()


def parents(messages: DataFrame) -> DataFrame:
    """messages (conv, turn, text) -> (conv, turn, parent, links) of messages with a linked quote."""
    quoting = messages.where(F.col("text").rlike(f"(?m){_MARKS}"))
    around = messages.join(quoting.select("conv").distinct(), "conv", "left_semi")
    units = _passages(around)
    # originals and quotes of one passage meet ordered by turn; no pairs are made
    placed = units.withColumn("value", F.when(F.col("level") == 0, F.col("turn")))
    sources = _before(placed.groupBy("conv", "hash", "turn").agg(F.max("value").alias("value")), ["conv", "hash"]).select("conv", "hash", "turn", F.col("before").alias("source"))
    found = units.where("level > 0").join(sources.where("source is not null"), ["conv", "hash", "turn"])
    best = F.max(F.struct((-F.col("level")).alias("level"), F.col("length"), F.col("source")))
    return found.groupBy("conv", "turn").agg(best["source"].alias("linked"), F.count_distinct("hash").alias("links"))


def _before(rows: DataFrame, keys: list[str], levels: int = 2) -> DataFrame:
    """rows (keys, turn, value), one per turn -> with `before`, the largest value of the keys' rows of smaller turns."""
    window = Window.partitionBy(*keys, "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    if not levels:
        return rows.withColumn("block", F.lit(0)).withColumn("before", F.max("value").over(window)).drop("block")
    blocked = rows.withColumn("block", F.floor(F.col("turn") / BLOCK_TURNS))
    tops = blocked.groupBy(*keys, F.col("block").alias("turn")).agg(F.max("value").alias("value"))
    carried = _before(tops, keys, levels - 1).select(*keys, F.col("turn").alias("block"), F.col("before").alias("carried"))
    inside = blocked.withColumn("inside", F.max("value").over(window))
    return inside.join(carried, [*keys, "block"]).withColumn("before", F.coalesce(F.greatest("inside", "carried"), "inside", "carried")).select(*rows.columns, "before")


def reply_order(spark: SparkSession, table: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """table with parent_turn, quote_links, clean_text and reply_path, and the names these got."""
    scratch = Scratch(spark)
    messages = table.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("conv is not null and turn is not null")
    turns = _before(messages.select("conv", "turn").distinct().withColumn("value", F.col("turn")), ["conv"]).select("conv", "turn", F.col("before").alias("previous"))
    turns = turns.join(parents(messages), ["conv", "turn"], "left")
    turns = scratch.keep(turns.select("conv", "turn", "previous", F.coalesce("linked", "previous").alias("parent"), F.coalesce("links", F.lit(0)).cast("long").alias("links")))
    # a branch starts where the answer is not to the message right before; rows between belong to its chain
    start = F.col("parent").isNull() | (F.col("parent") != F.col("previous"))
    started = _before(turns.select("conv", "turn", "parent", "links", F.when(start, F.col("turn")).alias("value")), ["conv"])
    placed = scratch.keep(started.select("conv", "turn", "parent", "links", F.coalesce("value", "before").alias("branch")))

    step = F.array(F.struct(F.lit(1).alias("kind"), F.coalesce(-F.col("parent"), F.lit(0)).alias("a"), F.col("turn").alias("b")))
    at_parent = placed.select("conv", F.col("turn").alias("parent"), F.col("branch").alias("up"))
    branches = placed.where("turn = branch").join(at_parent, ["conv", "parent"], "left").select("conv", "branch", "up", step.alias("path"))
    branches = scratch.keep(branches)
    while branches.where("up is not null").limit(1).count():
        above = branches.select("conv", F.col("branch").alias("up"), F.col("up").alias("next_up"), F.col("path").alias("before"))
        branches = scratch.keep(branches.join(above, ["conv", "up"], "left").select("conv", "branch", F.col("next_up").alias("up"), F.concat(F.coalesce("before", F.array().cast(branches.schema["path"].dataType)), F.col("path")).alias("path")))
    names = {n: fresh(table, n) for n in ("parent_turn", "quote_links", "clean_text", "reply_path")}
    own = F.array(F.struct(F.lit(0).alias("kind"), F.col("turn").alias("a"), F.lit(0).cast("long").alias("b")))
    paths = placed.join(branches.select("conv", "branch", "path"), ["conv", "branch"]).select(
        F.col("conv").alias("_conv"), F.col("turn").alias("_turn"), F.col("parent").alias(names["parent_turn"]), F.col("links").alias(names["quote_links"]), F.concat("path", own).alias(names["reply_path"]))
    out = table.join(paths, (F.col(conv) == F.col("_conv")) & (F.col(turn).cast("long") == F.col("_turn")), "left").drop("_conv", "_turn")
    return out.withColumn(names["clean_text"], without_quotes(F.coalesce(F.col(text), F.lit("")))), names


def format_chat(role: Column, text: Column) -> Column:
    """One message in a plain chat format."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("user")), F.lit("|>\n"), text, F.lit("\n"))


def chat_rows(spark: SparkSession, table: DataFrame) -> DataFrame:
    """conversations -> one row per message with its parent, its place in reply order and its formatted text."""
    ordered, names = reply_order(spark, table)
    path = F.array_join(F.transform(F.col(names["reply_path"]), lambda p: F.concat_ws(":", p["kind"], p["a"], p["b"])), "/")
    return ordered.select("conv_id", "turn", "role", F.col(names["parent_turn"]).alias("parent_turn"), F.col(names["quote_links"]).alias("quote_links"),
                          path.alias("reply_path"), format_chat(F.col("role"), F.col(names["clean_text"])).alias("message"))
