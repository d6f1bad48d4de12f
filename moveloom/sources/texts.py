"""Text formats: PGN games, EPD lines, JSON lines, TSV ledgers, job folders, and their sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns of an experiment ledger.
LEDGER = "date string, network string, base string, change string, chunks string, games int, elo double, margin95 double, verdict string, source string"


def last_of(keys: Column, values: Column) -> Column:
    """A map of parallel lists; a key that comes again has its last value."""
    back, names = F.reverse(values), F.array_distinct(keys)
    return F.map_from_arrays(names, F.transform(names, lambda k: F.element_at(back, F.array_position(F.reverse(keys), k).cast("int"))))


def read_pgn(spark: SparkSession, path: str) -> DataFrame:
    """One row per game: headers (map), movetext, white, black, result, score of White (null unless decided or drawn).

    Games are split by the reader itself at each `[Event "`, whatever the line ends are, so a file of any size is read
    in pieces. Without the movetext selected, only headers are parsed.
    """
    raw = spark.read.option("lineSep", '[Event "').text(path).withColumn("value", F.regexp_replace("value", "\r", ""))
    game = raw.where(F.col("value").contains('"]')).select(F.concat(F.lit('[Event "'), F.col("value")).alias("game"))
    keys, values = (F.regexp_extract_all("game", F.lit(r'(?m)^\[(\w+) "([^"]*)"\]'), F.lit(k)) for k in (1, 2))
    header = game.select("game", last_of(keys, values).alias("headers"))
    text = F.trim(F.regexp_replace("game", r'(?m)^\[\w+ "[^"]*"\]\s*', ""))
    result = F.try_element_at("headers", F.lit("Result"))
    return header.select("headers", F.regexp_replace(text, r"\s+$", "").alias("movetext"), F.coalesce(F.try_element_at("headers", F.lit("White")), F.lit("?")).alias("white"), F.coalesce(F.try_element_at("headers", F.lit("Black")), F.lit("?")).alias("black"),
                         result.alias("result"), score_of(result).alias("score"))


def score_of(result: Column) -> Column:
    return F.when(result == "1-0", 1.0).when(result == "0-1", 0.0).when(result == "1/2-1/2", 0.5)


def movetext_tokens(text: Column) -> Column:
    """Moves without numbers, comments, variations marks and the result."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\{[^}]*\}", " "), r"\d+\.(\.\.)?|\$\d+|(1-0|0-1|1/2-1/2|\*)\s*$", " ")
    return F.filter(F.split(F.trim(bare), r"\s+"), lambda t: t != "")


def comments_of(text: Column, tag: str) -> Column:
    """Values of `[%tag value]` comments in order."""
    return F.regexp_extract_all(text, F.lit(rf"\[%{tag} ([^\]]*)\]"), F.lit(1))


def eval_cp(value: Column) -> Column:
    """Centipawns of an evaluation in pawns; a mate `#n` counts 3000 with its sign."""
    return F.when(value.startswith("#-"), -3000).when(value.startswith("#"), 3000).otherwise(F.rint(F.split(value, ",")[0].try_cast("double") * 100)).cast("int")


def clock_seconds(value: Column) -> Column:
    parts = F.split(value, ":")
    return parts[0].cast("double") * 3600 + parts[1].cast("double") * 60 + parts[2].cast("double")


def read_epd(spark: SparkSession, path: str, refuse_empty: bool = False) -> DataFrame:
    """Lines that are neither blank nor comments: key (first four fields) and opcodes `name value;` as a map."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    names, values = (F.regexp_extract_all("value", F.lit(r'(?:^|[ ;])(bm|am|ce|c0|id|mate|depth)[ =]"?([^;"]*)"?'), F.lit(k)) for k in (1, 2))
    out = lines.select(F.array_join(F.slice(F.split(F.split("value", ";")[0], r"\s+"), 1, 4), " ").alias("key"), last_of(names, values).alias("ops"), F.col("value").alias("line"))
    if refuse_empty and out.limit(1).count() == 0:
        raise ValueError(f"{path}: no position")
    return out


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """`position;depth;count` lines."""
    return spark.read.csv(path, sep=";", schema="fen string, depth int, n long")


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str, whole: bool = False) -> DataFrame:
    """Lines of a log that may still be written: what does not parse (a line cut short) is left for later.

    whole: the log is complete, so a line that does not parse is an error.
    """
    if whole:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    shape = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    raw = spark.read.schema(T.StructType([*shape.fields, T.StructField("_torn", T.StringType())])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_torn").json(path)
    return raw.where("_torn is null").drop("_torn")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """An experiment ledger; `-` is null, chunks are a list."""
    rows = spark.read.csv(path, sep="\t", schema=LEDGER, nullValue="-", header=True)
    return rows.withColumn("chunks", F.transform(F.split("chunks", ","), lambda c: F.trim(c)))


def read_jobs(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """One JSON file per job in folders by state; the file's name gives the order of submission."""
    rows = spark.read.schema(schema).option("multiLine", True).json(f"{folder}/*/*.json").select("*", "_metadata.file_path")
    return rows.withColumn("state", F.element_at(F.split("file_path", "/"), -2)).withColumn("file", F.element_at(F.split("file_path", "/"), -1)).drop("file_path")


def checked_files(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Paths whose size is the manifest's; incomplete ones are left out. Both are (path, size)."""
    return found.join(manifest.withColumnRenamed("size", "_size"), "path").where(F.col("size") == F.col("_size")).drop("_size")


def write_epd(lines: DataFrame, path: str, notes: list[str]) -> None:
    """Lines under a commented header, in one file: books are small; order column `at` decides."""
    spark = lines.sparkSession
    head = spark.createDataFrame([(-len(notes) + i, f"# {n}") for i, n in enumerate(notes)], "at long, line string")
    head.union(lines.select(F.col("at").cast("long"), "line")).coalesce(1).sortWithinPartitions("at").select("line").write.text(path)


def write_tsv(df: DataFrame, path: str) -> None:
    from ..functions.scalars import tsv_cell

    cells = [F.coalesce(tsv_cell(F.col(c).cast("string")), F.lit("-")).alias(c) for c in df.columns]
    df.select(*cells).write.mode("append").option("sep", "\t").option("header", True).option("quote", "\u0000").csv(path)


def pgn_of(plies: DataFrame, by: str, order: str, move: str, clock: str, evaluation: str | None = None) -> DataFrame:
    """Movetext with a clock comment per move, and one of its evaluation where that is given; plies of a game are gathered in their order."""
    item = F.struct(order, move, clock, *([evaluation] if evaluation else []))
    games = plies.groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("_p"))
    number = lambda x: F.when((x[order] % 2) == 1, F.concat(((x[order] + 1) / 2).cast("int").cast("string"), F.lit(". "))).otherwise(F.lit(""))
    shown = (lambda x: F.concat(F.lit("[%eval "), x[evaluation], F.lit("] "))) if evaluation else (lambda x: F.lit(""))
    text = F.array_join(F.transform("_p", lambda x: F.concat(number(x), x[move], F.lit(" {"), shown(x), F.lit("[%clk "), x[clock], F.lit("]}"))), " ")
    return games.select(by, text.alias("movetext"))


def write_pgn(games: DataFrame, path: str, headers: dict[str, Column], movetext: str, crlf: bool = False) -> None:
    """Games with their headers in this order, a blank line, the movetext and another; null headers are `?`."""
    end = "\r\n" if crlf else "\n"
    lines = [F.concat(F.lit(f'[{k} "'), F.coalesce(F.translate(v.cast("string"), '"', "'"), F.lit("?")), F.lit('"]')) for k, v in headers.items()]
    games.select(F.concat_ws(end, *lines, F.lit(""), F.col(movetext), F.lit("")).alias("value")).write.option("lineSep", end).text(path)
