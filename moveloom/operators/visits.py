"""Table functions: visitors that see a partition in order and may end it early, and generators of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.functions import SkipRestOfInputTableException, arrow_udtf, lit, udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..session import carried

VISIT, CODE = "visit", "code"


def visit(rows: DataFrame, by: Sequence[str], order: Sequence, codes: Callable) -> DataFrame:
    """The rows of each group that a visitor sees, in order, with their number and the code that it returned.

    codes takes an Arrow table of the group's next rows and returns a number for each; the first that is not zero ends
    the group, and the rows after it are neither handed over nor returned. A visitor that keeps something from one row
    to the next is a class, of which each group has its own; it needs no room for the group. Groups are Spark's
    partitions of a table argument, sorted outside of Python.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField(VISIT, T.LongType()), T.StructField(CODE, T.LongType())])
    own = codes

    class Visitor:
        def __init__(self):
            self.codes = own() if isinstance(own, type) else own
            self.seen = 0

        def eval(self, batch) -> Iterator:
            import numpy as np
            import pyarrow as pa

            table = batch if isinstance(batch, pa.Table) else pa.Table.from_batches([batch])
            found = np.asarray(self.codes(table), np.int64)
            ends = np.flatnonzero(found)
            n = int(ends[0]) + 1 if len(ends) else table.num_rows
            numbers = np.arange(self.seen + 1, self.seen + n + 1)
            self.seen += n
            yield table.slice(0, n).append_column(VISIT, pa.array(numbers, pa.int64())).append_column(CODE, pa.array(found[:n], pa.int64()))
            if len(ends):
                raise SkipRestOfInputTableException("the visitor has seen enough")

    return arrow_udtf(Visitor, returnType=schema)(rows.asTable().partitionBy(*by).orderBy(*order))


@udtf
class Plies:
    """plies(moves array<string>, outcome double, most int): each of the first moves with the line before it and the mover's outcome.

    outcome is White's; Black's is 1 less it; a null outcome gives nulls. No rows for a null or empty list.
    """

    @staticmethod
    def analyze(moves: AnalyzeArgument, outcome: AnalyzeArgument, most: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(moves.dataType, T.ArrayType):
            raise ValueError("the first argument of plies is a list of moves")
        if not most.isConstantExpression or most.value is None or most.value < 1:
            raise ValueError("plies takes a constant number of moves, one at least")
        return AnalyzeResult(T.StructType([T.StructField("ply", T.IntegerType()), T.StructField("line", T.StringType()), T.StructField("move", moves.dataType.elementType), T.StructField("points", T.DoubleType())]))

    def eval(self, moves, outcome, most) -> Iterator:
        for ply, move in enumerate((moves or [])[:most]):
            points = None if outcome is None else float(outcome) if ply % 2 == 0 else 1 - float(outcome)
            yield ply + 1, " ".join(moves[:ply]), move, points


def plies(games: DataFrame, keep: Sequence[str], moves: str, outcome: str, most: int) -> DataFrame:
    """The generator joined laterally: a row per game and ply with the game's columns `keep`."""
    from pyspark.sql import functions as F

    made = Plies(F.col(moves).outer(), F.col(outcome).cast("double").outer(), lit(most))
    return games.lateralJoin(made).select(*keep, "ply", "line", "move", "points")


carried(__name__)
