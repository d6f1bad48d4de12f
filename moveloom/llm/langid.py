"""Language identification with interpolated Kneser-Ney character models (operator 7).

A text is lower-cased, letters stay, every run of anything else becomes one blank. Each language gets
a model of order four with absolute discounting, whose lower orders count in how many contexts an
n-gram was seen. A worker holds the models as sorted arrays of hashed n-grams, one column of log
probabilities per language: an n-gram seen in any language is found by one binary search, any other
backs off. The language with the lowest cross-entropy per character wins. A logistic fit on part of the
sample turns the lead over the second language and the length into a probability, and a threshold on it
gives the calibrated rejection.

Learning reads labelled rows only, a bounded sample of them: MAX_DOCS per language, chosen by a hash of
the id among all labelled rows (the bound is expected, not exact), their whole texts. Prediction covers
every row and whole texts.

Defined cases: a null text or one without letters is `und` with score 0; rows without a label are not
learned from; letters beyond U+FFFF share 4096 symbols, by their code's residue; with one language only, that one is predicted; with none, all are `und`; equal texts get
equal predictions; an empty table gives an empty table.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import unit_hash

ORDER = 4
#: Documents per language that a model is fitted to, in expectation; a quarter of them calibrate.
MAX_DOCS = 1500
#: Accepted predictions should be right this often on the calibration rows.
ACCEPT_PRECISION = 0.99
UNKNOWN = "und"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 20


def _letters() -> np.ndarray:
    """Of code points up to 0xFFFF: the code itself if a letter, else 0."""
    return np.array([c if unicodedata.category(chr(c))[0] == "L" else 0 for c in range(1 << 16)], np.uint64)


class Reader:
    """Texts to hashed n-grams."""

    def __init__(self):
        self.table = _letters()

    def symbols(self, text: str) -> np.ndarray:
        """Letters and single blanks, ORDER - 1 blanks before and one after; empty without letters."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        wide = codes >= 1 << 16
        s = self.table[np.minimum(codes, (1 << 16) - 1)]
        if wide.any():  # letters beyond the first plane: one symbol of the private area for each residue
            s[wide] = [0xE000 + c % 0x1000 if unicodedata.category(chr(c))[0] == "L" else 0 for c in codes[wide]]
        keep = s != 0
        if not keep.any():
            return s[:0]
        keep[1:] |= s[:-1] != 0
        s = s[keep]
        if s[0] == 0:
            s = s[1:]
        if s[-1] == 0:
            s = s[:-1]
        return np.concatenate([np.zeros(ORDER - 1, np.uint64), s, np.zeros(1, np.uint64)])

    @staticmethod
    def packed(symbols: np.ndarray) -> np.ndarray:
        """The ORDER symbols that end at each position from ORDER - 1 on, 16 bits each."""
        out = symbols[: len(symbols) - ORDER + 1].copy()
        for k in range(1, ORDER):
            out = out << np.uint64(16) | symbols[k : len(symbols) - ORDER + 1 + k]
        return out


@dataclass
class Model:
    """Log probabilities of known n-grams by order, and log back-off weights of known contexts."""

    languages: list[str]
    keys: dict[int, np.ndarray] = field(default_factory=dict)
    logp: dict[int, np.ndarray] = field(default_factory=dict)
    contexts: dict[int, np.ndarray] = field(default_factory=dict)
    backoff: dict[int, np.ndarray] = field(default_factory=dict)
    calibration: tuple[float, ...] = (0.0, 1.0, 0.0, 0.0)
    threshold: float = 0.0


def _find(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, values), max(len(keys) - 1, 0))
    return at, keys[at] == values if len(keys) else np.zeros(len(values), bool)


def _hashed(packed: np.ndarray) -> np.ndarray:
    return packed * _MIX  # odd, so one to one


def _low(packed: np.ndarray, order: int) -> np.ndarray:
    return packed & np.uint64((1 << 16 * order) - 1)


def fit(languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """counts: per language the packed n-grams of order ORDER and how often each occurs."""
    model = Model(languages)
    size = len(languages)
    per_order: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {ORDER: [(k, c.astype(float)) for k, c in counts]}
    for n in range(ORDER - 1, 0, -1):
        # in how many contexts of one more symbol an n-gram ends: distinct longer n-grams with this ending
        per_order[n] = [tuple(np.unique(_low(k, n), return_counts=True)) for k, _ in per_order[n + 1]]
    everything = np.unique(np.concatenate([k for k, _ in per_order[1]])) if size else np.zeros(0, np.uint64)
    uniform = 1.0 / (len(everything) + 1)
    lower_keys, lower_p = np.zeros(1, np.uint64), np.full((1, size), uniform)
    for n in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([k for k, _ in per_order[n]]))
        context = keys >> np.uint64(16)
        contexts = np.unique(context)
        at_context = np.searchsorted(contexts, context)
        ending = _low(keys, n - 1) if n > 1 else np.zeros(len(keys), np.uint64)
        at_lower = np.searchsorted(lower_keys, ending)
        p, back = np.empty((len(keys), size)), np.ones((len(contexts), size))
        for j, (k, c) in enumerate(per_order[n]):
            c = np.asarray(c, float)
            n1, n2 = (c == 1).sum(), (c == 2).sum()
            discount = min(max(n1 / (n1 + 2 * n2), 0.1), 0.95) if n1 else 0.5
            own = np.zeros(len(keys))
            own[np.searchsorted(keys, k)] = c
            total = np.bincount(at_context, own, len(contexts))
            kinds = np.bincount(at_context, own > 0, len(contexts))
            seen = total > 0
            back[seen, j] = discount * kinds[seen] / total[seen]
            p[:, j] = np.maximum(own - discount, 0) / np.maximum(total, 1)[at_context] + back[at_context, j] * lower_p[at_lower, j]
        lower_keys, lower_p = keys, p
        for store, names, values in ((model.keys, keys, None), (model.contexts, contexts, None)):
            store[n] = names
        model.logp[n], model.backoff[n] = p, back
    for n in range(1, ORDER + 1):
        for keys, values in ((model.keys, model.logp), (model.contexts, model.backoff)):
            hashed = _hashed(keys[n])
            order = np.argsort(hashed)
            keys[n], values[n] = hashed[order], np.log(values[n][order]).astype(np.float32)
    return model


class Scorer:
    def __init__(self, model: Model):
        self.model, self.reader = model, Reader()
        self.unseen = np.full(len(model.languages), -np.log(len(model.keys.get(1, ())) + 1), np.float32)

    def _log_p(self, packed: np.ndarray, order: int = ORDER) -> np.ndarray:
        m = self.model
        if order == 0:
            return np.broadcast_to(self.unseen, (len(packed), len(m.languages)))
        part = _low(packed, order) if order < ORDER else packed
        at, known = _find(m.keys[order], _hashed(part))
        out = m.logp[order][at]
        if not known.all():
            rest = ~known
            lower = np.array(self._log_p(packed[rest], order - 1))
            where, there = _find(m.contexts[order], _hashed(part[rest] >> np.uint64(16)))
            lower[there] += m.backoff[order][where[there]]
            out[rest] = lower
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Per text and language the mean negative log probability of a symbol; beside it the number of symbols."""
        out, lengths = np.zeros((len(texts), len(self.model.languages))), np.zeros(len(texts), np.int64)
        waiting: list[tuple[int, np.ndarray]] = []
        held = 0

        def flush() -> None:
            nonlocal held
            if waiting:
                logs = self._log_p(np.concatenate([p for _, p in waiting]))
                starts = np.cumsum([0, *(len(p) for _, p in waiting[:-1])])
                sums = np.add.reduceat(logs, starts, axis=0, dtype=np.float64)
                for (i, _), row in zip(waiting, sums, strict=True):
                    out[i] -= row
                waiting.clear()
                held = 0

        for i, text in enumerate(texts):
            symbols = self.reader.symbols(text) if text else ()
            if not len(symbols):
                continue
            packed = self.reader.packed(symbols)
            lengths[i] = len(packed)
            for a in range(0, len(packed), _CHUNK):
                waiting.append((i, packed[a : a + _CHUNK]))
                held += len(waiting[-1][1])
                if held >= _CHUNK:
                    flush()
        flush()
        return out / np.maximum(lengths, 1)[:, None], lengths

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, calibrated probability and whether that is too low to rely on."""
        if not self.model.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        entropy, lengths = self.entropies(texts)
        best = entropy.argmin(axis=1)
        score = probability(features(entropy, lengths), self.model.calibration)
        score[lengths == 0] = 0.0
        names = [self.model.languages[b] if n else UNKNOWN for b, n in zip(best, lengths, strict=True)]
        return names, score, score < self.model.threshold


def features(entropy: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """One, the lead over the second language, that lead times the root of the length, log length."""
    lead = np.diff(np.sort(entropy, axis=1)[:, :2], axis=1)[:, 0] if entropy.shape[1] > 1 else np.ones(len(entropy))
    return np.stack([np.ones(len(lead)), lead, lead * np.sqrt(np.minimum(lengths, 10_000)), np.log1p(lengths)], axis=1)


def probability(x: np.ndarray, w: tuple[float, ...]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ np.asarray(w), -30, 30)))


def calibrate(x: np.ndarray, right: np.ndarray, ridge: float = 1.0, steps: int = 30) -> tuple[float, ...]:
    """Ridge-regularised logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(hessian, x.T @ (right - p) - ridge * w)
    return tuple(map(float, w))


def learn(spark: SparkSession, labelled: DataFrame, max_docs: int = MAX_DOCS, seed: int = 7) -> Model:
    """labelled: doc_id, text, lang. Only n-gram counts of the bounded sample and its lengths reach the driver."""
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    totals = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        return Model([])
    share: Column = F.lit(0.0)
    for lang in languages:
        share = F.when(F.col("lang") == lang, min(1.0, max_docs / totals[lang])).otherwise(share)
    sample = usable.where(unit_hash(seed, F.col("doc_id")) < share).select("lang", "text", (unit_hash(seed + 1, F.col("doc_id")) < 0.25).alias("check"))

    def grams(batches: Iterator) -> Iterator:
        import pandas as pd

        reader = Reader()
        for pdf in batches:
            for lang, texts in pdf.groupby("lang").text:
                parts = [reader.packed(s) for t in texts if len(s := reader.symbols(t))]
                if parts:
                    keys, counts = np.unique(np.concatenate(parts), return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": keys.view(np.int64), "n": counts})

    counted = sample.where(~F.col("check")).select("lang", "text").mapInPandas(grams, "lang string, gram long, n long")
    rows = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    per_language = []
    for lang in languages:
        own = rows[rows.lang == lang]
        keys = own.gram.to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys)
        per_language.append((keys[order], own.n.to_numpy(np.int64)[order]))
    if not sum(len(k) for k, _ in per_language):
        return Model([])
    model = fit(languages, per_language)
    shared = spark.sparkContext.broadcast(model)

    def check(batches: Iterator) -> Iterator:
        import pandas as pd

        scorer = Scorer(shared.value)
        for pdf in batches:
            entropy, lengths = scorer.entropies(list(pdf.text))
            x = features(entropy, lengths)
            names = np.array(scorer.model.languages, object)[entropy.argmin(axis=1)]
            out = pd.DataFrame(x, columns=["a", "b", "c", "d"]).assign(right=(names == pdf.lang.to_numpy()).astype(float))
            yield out[lengths > 0]

    seen = sample.where("check").select("lang", "text").mapInPandas(check, "a double, b double, c double, d double, right double").toPandas()
    if len(seen):
        x, right = seen[["a", "b", "c", "d"]].to_numpy(), seen.right.to_numpy()
        model.calibration = calibrate(x, right)
        p = probability(x, model.calibration)
        order = np.argsort(-p)
        precise = np.cumsum(right[order]) / np.arange(1, len(p) + 1) >= ACCEPT_PRECISION
        model.threshold = float(p[order][np.flatnonzero(precise)[-1]]) if precise.any() else 1.0
    return model


def identify(spark: SparkSession, docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` with lang_pred, score and rejected."""
    at, positions = docs.columns.index(text), [docs.columns.index(c) for c in keep]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample it was fitted to

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scorer = Scorer(shared.value)
        for batch in batches:
            names, score, rejected = [], [], []
            for a in range(0, batch.num_rows, 256):
                part = scorer.predict(batch.column(at).slice(a, 256).to_pylist())
                names += part[0]
                score += part[1].tolist()
                rejected += part[2].tolist()
            arrays = [batch.column(p) for p in positions] + [pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.mapInArrow(run, schema)


def fold(doc_id: Column) -> Column:
    """True for held-out rows: CRC-32 of the id's digits leaves 2 on division by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify_held_out(spark: SparkSession, docs: DataFrame) -> DataFrame:
    slim = docs.select("doc_id", "text", "lang").withColumn("held_out", fold(F.col("doc_id")))
    model = learn(spark, slim.where(~F.col("held_out")))
    return identify(spark, slim.drop("lang"), model, ["doc_id", "held_out"])
