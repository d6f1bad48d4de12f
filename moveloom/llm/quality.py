r"""Quality rules with verdicts per host (operator 6).

Each document is measured by itself; a document that breaks a base rule fails. Failures are then
summed per host (here: the source), each host's rate is shrunk towards the mean of all hosts with a
beta prior fitted to the hosts' own rates by moments, and a host is rejected when the shrunk rate
passes `max_rate`. The verdict is joined back, so all documents of a rejected host go.

Defined cases: a null text has no words, so it fails; an empty text likewise; a null host is judged
by the document alone; equal rows get equal measures; an empty table gives an empty table; very long
texts are measured whole, one at a time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Scratch, fresh, with_group

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: A host goes when its shrunk failure rate is above this: most of what it publishes fails.
MAX_HOST_RATE = 0.6
#: Strength of the prior, in documents, where the hosts' rates do not vary enough to fit one.
DEFAULT_STRENGTH = 20.0
_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = re.compile(rb"[#*$%&|<>]")

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """The five measures of one text. bytes.split() splits at exactly the six ASCII white-space bytes."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return 0, 0, len(_SYMBOLS.findall(raw)), 0, 0
    chars = len(text) - sum(text.count(c) for c in _SPACES)
    lines = raw.split(b"\n")
    dup_lines = 0
    if len(lines) > 1 and len(set(lines)) < len(lines):
        kept = [line for line in lines if line.split()]
        dup_lines = len(kept) - len(set(kept))
    repeat = 0
    if n > WINDOW:
        windows = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
        if len(set(windows)) < len(windows):
            counts, reach = Counter(windows), 0
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    repeat += i + WINDOW - max(reach, i)
                    reach = i + WINDOW
    return n, chars, len(_SYMBOLS.findall(raw)), dup_lines, repeat


def with_measures(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """docs (or its columns `keep`) with the measures; also the names they got, free of clashes."""
    keep = docs.columns if keep is None else keep
    names = {m: fresh(docs, m) for m in MEASURES}
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(n, T.LongType(), False) for n in names.values())])
    at = docs.columns.index(text)
    positions = [docs.columns.index(c) for c in keep]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = [measure(t.as_py()) for t in batch.column(at)]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in MEASURES]
            arrays = [batch.column(p) for p in positions] + [pa.array(c, pa.int64()) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema])

    return docs.mapInArrow(run, schema), names


def base_failed(names: dict[str, str]):
    return (F.col(names["n_words"]) < MIN_WORDS) | (100 * F.col(names["n_repeat_words"]) > MAX_REPEAT_PERCENT * F.col(names["n_words"]))


def host_verdicts(rows: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(host, failed) -> (host, n_docs, n_failed, shrunk_rate, rejected), one row per non-null host.

    The prior's mean is the hosts' mean rate; its strength follows from how much more the rates vary
    than sampling alone would have them vary. Only this one row of moments reaches the driver. The result is
    written down.
    """
    scratch = Scratch(rows.sparkSession)
    hosts = scratch.keep(rows.where(F.col("host").isNotNull()).groupBy("host").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed")))
    rate = F.col("n_failed") / F.col("n_docs")
    row = hosts.agg(F.sum("n_failed").alias("f"), F.sum("n_docs").alias("n"), F.count(F.lit(1)).alias("h"), F.var_samp(rate).alias("v"), F.avg(1 / F.col("n_docs")).alias("inv")).first()
    mean = (row.f + 0.5) / (row.n + 1.0) if row and row.n else 0.5
    spread = mean * (1 - mean)
    extra = (row.v or 0.0) - spread * (row.inv or 0.0) if row and row.h > 1 else 0.0
    strength = min(max(spread / extra - 1, 1.0), 1000.0) if extra > 0 else DEFAULT_STRENGTH
    shrunk = (F.col("n_failed") + mean * strength) / (F.col("n_docs") + strength)
    return scratch.keep(hosts.withColumn("shrunk_rate", shrunk).withColumn("rejected", F.col("shrunk_rate") > max_rate))


def _measured_verdicts(rows: DataFrame, names: dict[str, str], host: str, max_rate: float) -> DataFrame:
    """host_verdicts of measured rows."""
    return host_verdicts(rows.select(F.col(host).alias("host"), base_failed(names).alias("failed")), max_rate)


def _with_verdicts(rows: DataFrame, names: dict[str, str], verdicts: DataFrame, docs: DataFrame, host: str) -> tuple[DataFrame, dict[str, str]]:
    """Measured rows of docs with base_failed, host_rate and kept."""
    names = names | {n: fresh(docs, n) for n in ("base_failed", "host_rate", "kept")}
    key, gone = fresh(docs, "_host_key"), fresh(docs, "_host_rejected")
    verdicts = verdicts.select(F.col("host").alias(key), F.col("shrunk_rate").alias(names["host_rate"]), F.col("rejected").alias(gone))
    judged = with_group(rows, verdicts, host, key).withColumn(names["base_failed"], base_failed(names))
    judged = judged.withColumn(names["kept"], ~F.col(names["base_failed"]) & ~F.coalesce(F.col(gone), F.lit(False)))
    return judged.drop(gone), names


def judge(docs: DataFrame, host: str = "source", text: str = "text", max_rate: float = MAX_HOST_RATE, keep: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """docs (or its columns `keep`, the host among them) with measures, base_failed, host_rate and kept; the names of these columns beside it.

    Each text is measured once: the measured rows are written down, and read again for the sums and for the result.
    """
    measured, names = with_measures(docs, text, keep)
    rows = Scratch(docs.sparkSession).keep(measured)
    return _with_verdicts(rows, names, _measured_verdicts(rows, names, host, max_rate), docs, host)


def keep_good(docs: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The documents kept, with the columns of docs.

    Each text is measured twice, for the sums and for the result, so that no text is written down.
    """
    host = "source"
    verdicts = _measured_verdicts(*with_measures(docs.select(host, "text"), keep=[host]), host, max_rate)
    judged, names = _with_verdicts(*with_measures(docs), verdicts, docs, host)
    return judged.where(F.col(names["kept"])).select(*docs.columns)
