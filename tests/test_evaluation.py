import math
import random

import pytest
from pyspark.sql import functions as F

from fityard.functions.vectors import as_vector
from fityard.operators import evaluation as ev
from tests.conftest import rows_of


def _scored(n=400, seed=2, levels=25):
    """A third of the rows share one score; the rest has ties too."""
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        s = 0.5 if rnd.random() < 0.33 else rnd.randrange(levels) / levels - 0.25
        rows.append((s, float(rnd.random() < 1 / (1 + math.exp(-2 * s)))))
    return rows


@pytest.fixture
def scored(spark):
    return spark.createDataFrame(_scored(), "margin double, label double").repartition(5)


def test_auc_counts_pairs(scored):
    rows = _scored()
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    won = sum((p > q) + (p == q) / 2 for p in pos for q in neg)
    assert ev.auc(scored).first()["auc"] == pytest.approx(won / len(pos) / len(neg), abs=1e-12)


def test_roc_has_every_threshold(scored):
    rows = _scored()
    n1 = sum(y for _, y in rows)
    want = [(t, sum(s >= t and not y for s, y in rows) / (len(rows) - n1),
             sum(s >= t and y == 1 for s, y in rows) / n1) for t in sorted({s for s, _ in rows})]
    got = rows_of(ev.roc_curve(scored))
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(g == pytest.approx(w, abs=1e-12) for g, w in zip(got, want))


def test_best_threshold(scored):
    rows = _scored()
    acc = {t: sum((s >= t) == (y == 1) for s, y in rows) / len(rows) for t in {s for s, _ in rows}}
    best = max(acc.values())
    got = ev.best_threshold_accuracy(scored).first()
    assert got["accuracy"] == pytest.approx(best) and got["threshold"] == min(
        t for t, a in acc.items() if a == best)


def test_ties_take_the_smallest_threshold(spark):
    df = spark.createDataFrame([(0.1, 1.0), (0.2, 0.0), (0.3, 1.0)], "margin double, label double")
    assert rows_of(ev.best_threshold_accuracy(df)) == [(0.1, pytest.approx(2 / 3))]


def test_performance_clips_probabilities(spark):
    df = spark.createDataFrame([(5.0, 1.0, 1.0, 0.0), (-5.0, 0.0, 0.0, 0.0), (0.0, 0.5, 0.0, 1.0)],
                               "margin double, probability double, prediction double, label double")
    r = ev.model_performance(df).first()
    assert r["n"] == 3 and r["accuracy"] == pytest.approx(1 / 3) and r["auc"] == 0.5
    assert r["log_loss"] == pytest.approx((-math.log(1e-15) + math.log(2)) / 3, rel=1e-2)
    assert r["rmse"] == pytest.approx(math.sqrt(1.25 / 3))


def test_hits_and_confusion(spark):
    df = spark.createDataFrame([(1.0, 1.0), (0.0, 1.0), (None, 1.0), (0.0, 0.0)],
                               "prediction double, label double")
    assert rows_of(ev.hit_rate(df)) == [(2, 4, 0.5)]
    assert rows_of(ev.accuracy(df)) == [(4, 0.5)]
    counts = ev.confusion_matrix(df.filter("prediction is not null"))
    assert rows_of(counts) == [(0.0, 0.0, 1), (1.0, 0.0, 1), (1.0, 1.0, 1)]


def test_clusters_against_labels(spark):
    df = spark.createDataFrame([(0, 1.0)] * 3 + [(1, 0.0)] * 2 + [(1, 1.0)], "prediction int, label double")
    assert rows_of(ev.cluster_label_agreement(df)) == [
        (6, pytest.approx(1 / 6), pytest.approx(5 / 6))]
    assert rows_of(ev.cluster_label_crosstab(df, [0, 1])) == [(0.0, 0, 2), (1.0, 3, 1)]


def test_silhouette_of_pairs(spark):
    pts = [(random.Random(i).gauss(3 * (i % 2), 1), i % 2) for i in range(40)]
    df = spark.createDataFrame(pts, "x double, prediction int").select(
        F.array("x").alias("a"), "prediction")
    df = df.select(as_vector("a").alias("features"), "prediction")

    def one(x, k):
        same = [(x - z) ** 2 for z, j in pts if j == k]
        other = [(x - z) ** 2 for z, j in pts if j != k]
        a, b = sum(same) / (len(same) - 1), sum(other) / len(other)
        return (b - a) / max(a, b)

    want = sum(one(*p) for p in pts) / len(pts)
    assert ev.silhouette(df).first()[0] == pytest.approx(want, abs=1e-9)


def test_models_side_by_side(spark):
    df = spark.createDataFrame([(1.0, 0.0, 1.0), (1.0, 0.0, 0.0)], "p double, q double, label double")
    assert rows_of(ev.model_comparison(df, {"p": "p", "q": "q"})) == [(2, 0.5, 0.5)]
