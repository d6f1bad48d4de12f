r"""Quality scores by Bradley-Terry preferences (operator 11).

Labelled documents make preference pairs: one of label 1 is preferred to one of label 0. The probability of a
preference is the logistic function of the difference of two scores, and a score is linear in features of the text
(FEATURES: shares of kinds of characters, words and lines, repetition, length).

1. One pass over all texts computes the features; what follows reads only these.
2. Each labelled document meets PAIRS of the other label. Both labels are numbered in hash order and number i meets
   numbers i + k * stride, wrapped, so every document is in as many pairs as any other of its label, and pairs grow with labelled
   documents, not with their square. All labelled documents take part.
3. Newton steps on the logistic loss of feature differences, with a ridge. A task sums gradient and Hessian of its
   pairs; what meets in one place is a vector and a matrix of the features' number, whatever the corpus.
4. Scores of the labelled documents are cut into QUANTILES. The quantile that separates the labels best (mean of both
   labels' hit rates) is the threshold; a logistic curve through it, fitted to the quantiles' counts, makes scores
   between 0 and 1 with 0.5 at the threshold.

Defined cases: a null text has the features of the empty one, and both get a score; labels other than 0 and 1, labels
without a document and null ids teach nothing; an id with several labels or documents counts once for each pair of them; where
labels 0 or 1 lack, every score is 1, 0 or 0.5 (only 1, only 0, none); equal texts have equal scores; long texts are
read whole; an empty table gives an empty one; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Scratch, prefix_sums, unit_hash

PAIRS = 4
QUANTILES = 256
STEPS = 12
RIDGE = 1e-3
SEED = 11

_GROUPS = {"letters": rb"[A-Za-z\x80-\xff]", "capitals": rb"[A-Z]", "digits": rb"[0-9]", "symbols": rb"[#*$%&|<>=~^_{}\[\]\\/@+]", "marks": rb"[!?]", "stops": rb"[.,;:]", "blanks": rb"[\x20\x09-\x0D]", "odd": rb"[\x00-\x08\x0E-\x1F\x7F]"}
_CLASSES = np.array([[bool(re.match(p, bytes([b]))) for b in range(256)] for p in _GROUPS.values()], float)
_NAMES = (*_GROUPS, "wordless", "shouted", "ends_in_symbol", "echoed", "commonest", "repeated", "same_lines")
#: Shares, each also as its square root, which tells small shares apart, and three lengths.
FEATURES = (*_NAMES, *(f"root_{n}" for n in _NAMES), "log_words", "log_word_length", "log_line_length", "variety")


def features(text: str | None) -> np.ndarray:
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n, chars = len(words), max(1, len(data))
    shares = [*(_CLASSES @ np.bincount(np.frombuffer(data, np.uint8), minlength=256) / chars)]
    if n:
        counts = Counter(words)
        own = {w: _looks(w.decode("utf-8", "replace")) for w in counts}
        table = np.array([(*own[w], k) for w, k in counts.items()], float)
        shares += [*(table[:, 3] @ table[:, :3] / n)]
        ids = {w: i for i, w in enumerate(counts)}
        at = np.fromiter((ids[w] for w in words), np.int64, n)
        shares += [float((at[1:] == at[:-1]).sum()) / n, (counts.most_common(1)[0][1] - 1) / n, _repeated(at) / n]
        lines = [x for x in data.split(b"\n") if x.strip()]
        shares.append(1 - len(set(lines)) / len(lines))
        lengths = [np.log1p(n), np.log1p(sum(map(len, words)) / n), np.log1p(n / len(lines)), np.log1p(len(counts)) / np.log1p(n)]
    else:
        shares += [0.0] * 7
        lengths = [0.0] * 4
    return np.array([*shares, *np.sqrt(shares), *lengths])


def _looks(word: str) -> tuple[bool, bool, bool]:
    """Whether a word has no letter or digit, is in capitals, and ends in a symbol."""
    return not any(map(str.isalnum, word)), len(word) > 1 and word.isupper(), word[-1] in "#*$%&|<>=~^_{}[]\\/@+!"


def _repeated(at: np.ndarray, width: int = 5) -> int:
    """Words in windows of five that occur more than once."""
    if len(at) < width:
        return 0
    h = np.zeros(len(at) - width + 1, np.uint64)
    for k in range(width):
        h = (h + at[k : len(h) + k].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    _, back, counts = np.unique(h, return_inverse=True, return_counts=True)
    change = np.zeros(len(at) + 1, np.int64)
    twice = np.flatnonzero(counts[back] > 1)
    np.add.at(change, twice, 1)
    np.add.at(change, twice + width, -1)
    return int((np.cumsum(change) > 0).sum())


def with_features(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, x."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = [features(v.as_py()) for v in batch.column(1)]
            flat = pa.array(np.concatenate(rows) if rows else np.zeros(0))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES)), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "x"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("x", T.ArrayType(T.DoubleType(), False), False)])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


def _summed(df: DataFrame, width: int, part) -> np.ndarray:
    """The sum over all batches of part(batch), a vector of width numbers; each task sends one row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(width)
        for batch in batches:
            if len(batch):
                total += part(batch)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(total)], names=["k", "v"])

    rows = df.mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()  # width rows, whatever the input
    out = np.zeros(width)
    for k, v in rows:
        out[k] = v
    return out


def paired(scratch: Scratch, labelled: DataFrame, pairs: int = PAIRS, seed: int = SEED) -> tuple[DataFrame, int, int]:
    """(doc_id, label, x) -> (better, worse), the features of each pair; and how many labels are 1 and 0."""
    labelled = scratch.keep(labelled.withColumn("u", unit_hash(seed, F.col("doc_id"))))
    counts = {r.label: r.n for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    ones, zeros = counts.get(1, 0), counts.get(0, 0)
    sides = {}
    for label in (0, 1):
        own = labelled.where(F.col("label") == label).select("u", "doc_id", "x")
        sides[label] = scratch.keep(prefix_sums(scratch, own, [F.col("u"), F.col("doc_id"), F.col("x")], {"number": F.lit(1).cast("long")}).select("number", "x"))
    many, few = (1, 0) if ones >= zeros else (0, 1)
    least = max(1, min(ones, zeros))
    stride = max(1, least // pairs)
    wanted = F.explode(F.array(*(F.lit(k * stride) for k in range(pairs))))
    met = sides[many].select("x", "number", wanted.alias("step")).select(F.col("x").alias("many"), ((F.col("number") + F.col("step")) % least).alias("number"))
    both = met.join(sides[few].withColumnRenamed("x", "few"), "number")
    better, worse = ("many", "few") if many == 1 else ("few", "many")
    return scratch.keep(both.select(F.col(better).alias("better"), F.col(worse).alias("worse"))), ones, zeros


def fit(pairs: DataFrame, center: np.ndarray, scale: np.ndarray, steps: int = STEPS, ridge: float = RIDGE) -> np.ndarray:
    """Weights that minimise the mean logistic loss of scaled feature differences plus the ridge."""
    d = len(scale)
    weights = np.zeros(d)

    for _ in range(steps):

        def part(batch, weights=weights):
            x = (_matrix(batch.column(0)) - _matrix(batch.column(1))) / scale
            wrong = 1 / (1 + np.exp(np.clip(x @ weights, -500, 500)))
            return np.concatenate([[len(x)], x.T @ wrong, ((x * (wrong * (1 - wrong))[:, None]).T @ x).ravel()])

        total = _summed(pairs, 1 + d + d * d, part)
        n, gradient, hessian = total[0], total[1 : d + 1], total[d + 1 :].reshape(d, d)
        step = np.linalg.solve(hessian / n + ridge * np.eye(d), gradient / n - ridge * weights)
        weights = weights + step * min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return weights


def threshold(table: list[tuple[float, int, int]]) -> tuple[float, float]:
    """(score, zeros, ones) per quantile, ascending -> the score that separates best and the slope of a logistic curve through it."""
    score, zeros, ones = (np.array(c, float) for c in zip(*table, strict=True))
    below0, below1 = np.cumsum(zeros), np.cumsum(ones)
    hits = below0 / below0[-1] + (below1[-1] - below1) / below1[-1]
    k = int(np.argmax(hits[:-1])) if len(score) > 1 else 0
    # scores are the quantiles' greatest: the cut lies between a quantile's and the next one's
    cut = (score[k] + score[min(k + 1, len(score) - 1)]) / 2
    x, slope = score - cut, 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * x, -500, 500)))
        gradient = (ones - (ones + zeros) * p) @ x - 1e-3 * slope
        curve = ((ones + zeros) * p * (1 - p)) @ x**2 + 1e-3
        slope = min(100.0, max(1e-3, slope + gradient / curve))
    return float(cut), float(slope)


class Model:
    """score(x): between 0 and 1."""

    def __init__(self, weights: np.ndarray, center: np.ndarray, scale: np.ndarray, cut: float, slope: float):
        self.weights, self.center, self.scale, self.cut, self.slope = weights, center, scale, cut, slope

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (x - self.center) / self.scale @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.raw(x) - self.cut), -500, 500)))


def _scores(df: DataFrame, model: Model, how: str, keep: list[str]) -> DataFrame:
    """The columns `keep` of df (…, x) and score."""
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("score", T.DoubleType(), False)])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = _matrix(batch.column(len(keep))) if len(batch) else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(getattr(model, how)(x))], names=schema.names)

    return df.select(*keep, "x").mapInArrow(run, schema)


def learn(scratch: Scratch, labelled: DataFrame) -> Model | float:
    """(doc_id, label, x) -> the model, or a constant score where a label lacks."""
    labelled = scratch.keep(labelled)
    pairs, ones, zeros = paired(scratch, labelled)
    if not ones or not zeros:
        return 1.0 if ones else 0.0 if zeros else 0.5
    d = len(FEATURES)

    def part(batch):
        x = _matrix(batch.column(0))
        return np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])

    total = _summed(labelled.select("x"), 1 + 2 * d, part)
    center = total[1 : d + 1] / total[0]
    scale = np.sqrt(np.maximum(total[d + 1 :] / total[0] - center**2, 0))
    scale = np.where(scale > 1e-9, scale, 1.0)
    model = Model(fit(pairs, center, scale), center, scale, 0.0, 1.0)
    scored = scratch.keep(_scores(labelled, model, "raw", ["label"]))
    cuts = sorted(set(scored.agg(F.percentile_approx("score", [k / QUANTILES for k in range(1, QUANTILES)], 10_000).alias("c")).first().c))
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("score")))
    table = scored.groupBy(place.alias("place")).agg(F.max("score").alias("score"), F.sum(1 - F.col("label")).alias("zeros"), F.sum("label").alias("ones")).orderBy("place")
    model.cut, model.slope = threshold([tuple(r)[1:] for r in table.collect()])  # QUANTILES rows at most
    return model


def score_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text), labels (doc_id, label) -> doc_id and score of every document, learned from all labels given."""
    scratch = Scratch(spark)
    rows = scratch.keep(with_features(docs))
    known = labels.where("label in (0, 1)").select("doc_id", F.col("label").cast("int").alias("label"))
    model = learn(scratch, rows.join(known, "doc_id").select("doc_id", "label", "x"))
    return rows.select("doc_id", F.lit(model).alias("score")) if isinstance(model, float) else _scores(rows, model, "score", ["doc_id"])


def quality_digest(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores learned from the labels of two thirds of the ids."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    known = labels.where(~held).select("doc_id", F.col("quality").alias("label"))
    scored = score_documents(spark, docs, known)
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
