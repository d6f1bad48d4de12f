r"""Periodic runs of words on a harmonic grid (operator 12).

A run is a stretch of words in which words q apart are identical, q its smallest period, that no neighbouring word
extends and that is at least `least` words and `times` periods long. For each period p, places where words p apart
agree form stretches; one that belongs to a run is at least gap = max(least - p, (times - 1) p) long, so it holds a
multiple of gap. These grid points number n / gap for each p, a harmonic sum: n log n over all periods.

1. Grid points of a block of periods are laid out as two NumPy vectors, and those whose words p apart differ go.
2. For all that remain, how far words agree onwards and backwards (the longest common extension) is found by binary
   search on prefix hashes, for all (period, grid point) pairs at once: equal words always have equal hashes, so an
   extension is never found too short.
3. Stretches that are long enough are one run each, whatever grid points and multiples of the period found them: with
   equal ends, the smallest period counts and its multiples say the same. The words of each are compared; where hashes
   lied, the extension is taken from the words themselves.

Each text is worked on whole in one task; memory grows with its words and a bounded block of pairs, never with pairs
of words. Nothing is shuffled.

Defined cases: a null, empty or blank text has no words and no runs; repeated rows get equal results; null ids are
ids like any other; an empty table gives an empty one; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import WORD_GAP, fresh

LEAST = 24
TIMES = 3
#: (period, grid point) pairs looked at together.
BLOCK_PAIRS = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)

RUNS_TYPE = T.ArrayType(T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")]), False)


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, that of its first place."""
    known: dict[bytes, int] = {}
    return np.fromiter(map(known.setdefault, words, range(len(words))), np.int64, len(words))


class Hashes:
    """Prefix sums of word codes times powers of an odd base, modulo 2**64."""

    def __init__(self, ids: np.ndarray):
        codes = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
        codes ^= codes >> np.uint64(29)
        self.power = np.full(len(ids) + 1, _BASE, np.uint64)
        self.power[0] = 1
        np.multiply.accumulate(self.power, out=self.power)
        self.sums = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum(codes * self.power[:-1], out=self.sums[1:])

    def equal(self, at: np.ndarray, period: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether length words from at and from at + period agree, as far as hashes tell."""
        near = self.sums[at + length] - self.sums[at]
        far = self.sums[at + period + length] - self.sums[at + period]
        return near * self.power[period] == far


def extended(hashes: Hashes, at: np.ndarray, period: np.ndarray, n: int, back: bool) -> np.ndarray:
    """For all pairs, over how many words from at (or, back, before at) the words period apart agree."""
    low, high = np.zeros(len(at), np.int64), (at if back else n - period - at).astype(np.int64)
    while (open_ := low < high).any():
        middle = (low + high + 1) >> 1
        good = hashes.equal(at - middle if back else at, period, middle)
        low = np.where(open_ & good, middle, low)
        high = np.where(open_ & ~good, middle - 1, high)
    return low


def grid(n: int, first: int, last: int, least: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid points and periods of the periods first to last - 1."""
    periods = np.arange(first, last)
    gaps = np.maximum(least - periods, (times - 1) * periods)
    counts = (n - periods + gaps - 1) // gaps
    starts = np.cumsum(counts) - counts
    return (np.arange(counts.sum()) - np.repeat(starts, counts)) * np.repeat(gaps, counts), np.repeat(periods, counts)


def _by_words(ids: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """Begin and end of the run around at, by comparing words."""
    differ = np.flatnonzero(ids[:-period] != ids[period:])
    k = np.searchsorted(differ, at)
    begin = int(differ[k - 1]) + 1 if k else 0
    end = int(differ[k]) if k < len(differ) else len(ids) - period
    return begin, end + period


def runs_of(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    n, found, hashes = len(ids), [], None
    first, longest = 1, n // times
    if n < least:
        return []
    while first <= longest:
        gap = max(least - first, (times - 1) * first)
        last = min(longest + 1, first + max(1, BLOCK_PAIRS * gap // n))
        at, period = grid(n, first, last, least, times)
        same = np.flatnonzero(ids[at] == ids[at + period])
        at, period, first = at[same], period[same], last
        if not len(at):
            continue
        hashes = hashes or Hashes(ids)
        begin = at - extended(hashes, at, period, n, back=True)
        end = at + extended(hashes, at, period, n, back=False) + period
        enough = np.flatnonzero(end - begin >= np.maximum(least, times * period))
        if len(enough):
            found.append(np.stack([begin[enough], end[enough], period[enough], at[enough]], axis=1))
    if not found:
        return []
    pairs = np.concatenate(found)
    pairs = pairs[np.lexsort((pairs[:, 3], pairs[:, 2], pairs[:, 1], pairs[:, 0]))]
    runs: dict[tuple[int, int], list[int]] = {}

    def known(begin: int, end: int, period: int) -> bool:
        return any(period % p == 0 for p in runs.get((begin, end), ()))

    for begin, end, period, at in pairs.tolist():
        if known(begin, end, period):
            continue
        if not np.array_equal(ids[begin : end - period], ids[begin + period : end]):
            begin, end = _by_words(ids, at, period)
            if end - begin < max(least, times * period) or known(begin, end, period):
                continue
        runs.setdefault((begin, end), []).append(period)
    return sorted((begin, end - begin, min(periods)) for (begin, end), periods in runs.items())


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words joined by single spaces, of each run only the first period."""
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(change)[:-1] == 0)
    return b" ".join(words if len(kept) == len(words) else [words[i] for i in kept]).decode()


def find_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, text: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, str, str]:
    """docs (or its columns `keep`) with all runs of words and the collapsed text; also the names of these two columns.

    times is 2 at least: with shorter runs, multiples of a period may have runs of their own.
    """
    if times < 2 or least < 1:
        raise ValueError("a run has two periods and one word at least")
    keep = docs.columns if keep is None else keep
    runs, rest = fresh(docs, "runs"), fresh(docs, "collapsed")
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(runs, RUNS_TYPE, False), T.StructField(rest, T.StringType(), False)])
    at, positions = docs.columns.index(text), [docs.columns.index(c) for c in keep]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([pa.field(n, pa.int64(), False) for n in ("start", "length", "period")]))
        for batch in batches:
            offsets, flat, texts = [0], [], []
            for value in batch.column(at):
                words = (value.as_py() or "").encode("utf-8", "surrogatepass").split()  # splits at the six ASCII white-space characters
                own = runs_of(numbered(words), least, times)
                flat += own
                offsets.append(len(flat))
                texts.append(collapsed(words, own))
            parts = np.array(flat, np.int64).reshape(-1, 3)
            structs = pa.StructArray.from_arrays([pa.array(parts[:, k]) for k in range(3)], fields=list(kind.value_type))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)
            yield pa.RecordBatch.from_arrays([*(batch.column(p) for p in positions), lists, pa.array(texts, pa.string())], names=schema.names)

    return docs.mapInArrow(run, schema), runs, rest


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def planted(text: Column, doc_id: Column) -> Column:
    """The text, one in ten by its id with words from a place on replaced by a repetition; a null id has none."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split(text, WORD_GAP), lambda w: w != "")

    def edited(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = (g % F.greatest(n, F.lit(1))).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        unit = F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int"))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a), F.slice(F.flatten(unit), F.lit(1), (n - a).cast("int"))), " ")).otherwise(text)

    return F.when(h % 10 == 0, _let(words, edited)).otherwise(text)


def runs_digest(docs: DataFrame) -> DataFrame:
    """Runs of the planted texts: their number, the one with most repeats, and hashes of all runs and of the collapsed text."""
    edited = docs.select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text"))
    found, runs, rest = find_runs(edited, keep=["doc_id"])
    more = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    # runs come by start, then period, so that the first of equal ones stays
    best = F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(more(r, best), r).otherwise(best))
    lines = F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = found.select("doc_id", F.size(runs).cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2(rest, 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
                      F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
