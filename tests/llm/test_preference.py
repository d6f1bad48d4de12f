"""Bradley-Terry quality scores: the fit, the pairs, the threshold, held-out accuracy and odd rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from moveloom.llm import preference
from moveloom.llm.shared import Scratch

from .fixtures import empty_docs, odd_docs, odd_rows

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return docs.select("doc_id", "text").cache(), labels.cache()


def test_features_by_hand():
    f = dict(zip(preference.FEATURES, preference.features("AB!! ab ab x$ 12\nab ab\nab ab"), strict=True))
    assert f["ends_in_symbol"] == 2 / 9 and f["shouted"] == 1 / 9 and f["echoed"] == 4 / 9
    assert f["commonest"] == 5 / 9 and f["same_lines"] == pytest.approx(1 / 3) and f["wordless"] == 0
    assert f["digits"] == 2 / 28 and f["root_digits"] == pytest.approx((2 / 28) ** 0.5)
    assert not preference.features("").any() and not preference.features(None).any()
    assert preference.features(" \t").any()  # blanks, but no words


def test_repeated_words_by_hand():
    rng = random.Random(1)
    for _ in range(50):
        at = [rng.randint(0, 1) for _ in range(rng.randint(0, 30))]
        windows = [tuple(at[i : i + 5]) for i in range(len(at) - 4)]
        inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
        assert preference._repeated(np.array(at, np.int64)) == len(inside)


def test_fit_is_the_minimum(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(2, 300, 3))
    prefer = 1 / (1 + np.exp(-(a - b) @ [1.0, -2.0, 0.0])) > rng.random(300)
    better, worse = np.where(prefer[:, None], a, b), np.where(prefer[:, None], b, a)
    rows = [(x.tolist(), y.tolist()) for x, y in zip(better, worse, strict=True)]
    weights = preference.fit(spark.createDataFrame(rows, "better array<double>, worse array<double>").repartition(5), np.zeros(3), np.ones(3), ridge=0.01)

    def loss(w):
        return np.log1p(np.exp(-(better - worse) @ w)).mean() + 0.005 * w @ w

    assert weights[0] > 0.5 and weights[1] < -1 and abs(weights[2]) < 0.4
    for k in range(3):
        for move in (-1e-3, 1e-3):
            assert loss(weights) < loss(weights + move * np.eye(3)[k])


def test_pairs_grow_with_documents(spark):
    rows = [(i, int(i % 7 > 0), [float(i)]) for i in range(700)]
    found, ones, zeros = preference.paired(Scratch(spark), spark.createDataFrame(rows, "doc_id long, label int, x array<double>"), pairs=3)
    pairs = [(r.better[0], r.worse[0]) for r in found.collect()]
    assert (ones, zeros) == (600, 100) and len(pairs) == len(set(pairs)) == 1800
    assert all(a % 7 and not b % 7 for a, b in pairs)
    assert {sum(p[0] == i for p in pairs) for i in range(700) if i % 7} == {3}
    assert {sum(p[1] == i for p in pairs) for i in range(0, 700, 7)} == {18}


def test_threshold_is_the_best_quantile():
    table = [(-2.0, 9, 0), (-1.0, 8, 1), (0.5, 1, 10), (1.0, 0, 9)]
    cut, slope = preference.threshold(table)
    assert cut == -0.25 and slope > 1


def test_held_out_accuracy(spark, tables):
    docs, labels = tables
    got = preference.quality_digest(spark, docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    held = got[got.held_out]
    assert len(held) > 80 and (held.predicted == held.quality).mean() > 0.97
    ones, zeros = held[held.quality == 1].score.values, held[held.quality == 0].score.values
    assert (ones[:, None] > zeros[None, :]).mean() > 0.99


def test_held_out_labels_teach_nothing(spark, tables):
    docs, labels = tables
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (preference.quality_digest(spark, docs, x).toPandas().set_index("doc_id").score.sort_index() for x in (labels, turned))
    assert np.allclose(a, b, atol=1e-6)


def test_odd_rows_and_labels(spark):
    labels = [(1, 1), (1, 0), (3, 0), (None, 1), (8, 1), (9, None), (10, 5), (12, 0), (13, 1), (999, 1)]
    labels = spark.createDataFrame([(*x, "y", 0.5) for x in labels], "doc_id long, quality int, text string, score double")
    got = preference.quality_digest(spark, odd_docs(spark), labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert sorted((r.doc_id for r in rows), key=str) == sorted((r[0] for r in odd_rows()), key=str)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    by = {r.doc_id: r.score for r in rows}
    assert by[1] == by[2] and by[3] == by[4]
    assert preference.quality_digest(spark, empty_docs(spark), labels).count() == 0


@pytest.mark.parametrize("quality, score", [([1, 1], 1.0), ([0], 0.0), ([], 0.5)])
def test_one_label_alone(spark, quality, score):
    docs = spark.createDataFrame([(k, "text") for k in range(4)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, q) for k, q in enumerate(quality)], "doc_id long, label int")
    assert {r.score for r in preference.score_documents(spark, docs, labels).collect()} == {score}
