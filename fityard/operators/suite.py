"""Fit, score and evaluate every registered model over one split; failures stay isolated."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from fityard.operators.evaluation import accuracy
from fityard.operators.kmeans import assign_clusters, fit_kmeans, fit_kmeans_seeded
from fityard.operators.linear import fit_elastic_net, fit_logreg, fit_logreg_newton, score_weights
from fityard.operators.mlp import fit_mlp, fit_mlp_tanh, score_network
from fityard.operators.pca import fit_pca, fit_pca_uncentered, project


@dataclass(frozen=True)
class ModelEntry:
    """How to fit a model, what to report of it on either side of the split, and how to score rows with it."""

    fit: Callable[[DataFrame], Any]
    train_metric: Callable[[Any], float | None]
    test_metric: Callable[[DataFrame], float | None]
    score: Callable[[Any, DataFrame], DataFrame] = lambda model, rows: model.transform(rows)


def force(df: DataFrame) -> None:
    """Compute all rows and throw them away; scoring is lazy otherwise."""
    df.write.format("noop").mode("overwrite").save()


def _test_accuracy(scored: DataFrame) -> float:
    return accuracy(scored).first()["accuracy"]


def _none(_) -> None:
    return None


def default_models(n_features: int, seed: int, k_pca: int = 10, logistic: dict | None = None,
                   network: dict | None = None) -> dict[str, ModelEntry]:
    """The four models of the first library's full run, in running order. The seed is that of k-means; ``logistic`` and
    ``network`` are further arguments of their fits."""
    return {
        "kmeans": ModelEntry(lambda df: fit_kmeans(df, seed), _none, _none),
        "logistic_regression": ModelEntry(lambda df: fit_logreg(df, **(logistic or {})), lambda m: m.summary.accuracy,
                                          _test_accuracy),
        "pca": ModelEntry(lambda df: fit_pca(df, k_pca),
                          lambda m: float(sum(m.explainedVariance)), _none),
        "mlp": ModelEntry(lambda df: fit_mlp(df, n_features, **(network or {})), _none, _test_accuracy),
    }


def second_models(feature_cols: Sequence[str], key: str, k_pca: int = 10, reg_param: float | None = None,
                  network: dict | None = None) -> dict[str, ModelEntry]:
    """The four models of the second library's full run, in running order: seeded k-means, a binomial linear model
    (elastic net of strength ``reg_param``, or without penalty), uncentered components with imputed values, and a tanh network
    (``network``: further arguments of its fit). Both sides need the plain columns, and the train side ``key``."""
    cols = list(feature_cols)
    if reg_param is None:
        linear = ModelEntry(lambda df: fit_logreg_newton(df, cols), _none, _test_accuracy,
                            lambda m, df: score_weights(df, cols, m.coefficients, m.intercept))
    else:
        linear = ModelEntry(lambda df: fit_elastic_net(df, reg_param), _none, _test_accuracy)
    return {
        "kmeans": ModelEntry(lambda df: fit_kmeans_seeded(df, cols, key, 2), _none, _none,
                             lambda m, df: assign_clusters(df, cols, m)),
        "logistic_regression": linear,
        "pca": ModelEntry(lambda df: fit_pca_uncentered(df, cols, k_pca), lambda m: float(sum(m[1])), _none,
                          lambda m, df: project(df, cols, m[0])),
        "mlp": ModelEntry(lambda df: fit_mlp_tanh(df, cols, **(network or {})), lambda m: m[1][-1], _test_accuracy,
                          lambda m, df: score_network(df, cols, m[0], "tanh")),
    }


def fit_all_models(train: DataFrame, test: DataFrame, models: dict[str, ModelEntry]) -> DataFrame:
    """``(ord, model, ok, error, train_metric, test_metric)``, one row per model.

    Both sides hold ``label`` and what the models read, and are cached once for all of them. A train side that is empty
    makes every model fail.
    """
    spark = train.sparkSession
    train, test = (df.persist(StorageLevel.MEMORY_AND_DISK) for df in (train, test))
    rows = []
    try:
        for ord_, (name, entry) in enumerate(models.items()):
            on_train = None
            try:
                model = entry.fit(train)
                on_train = entry.train_metric(model)
                scored = entry.score(model, test)
                on_test = entry.test_metric(scored)
                if on_test is None:
                    force(scored)
                rows.append((ord_, name, True, None, on_train, on_test))
            except Exception as failure:  # one model must not stop the others
                reason = (str(failure) or type(failure).__name__).splitlines()[0]
                rows.append((ord_, name, False, reason, on_train, None))
    finally:
        train.unpersist()
        test.unpersist()
    return spark.createDataFrame(
        rows, "ord int, model string, ok boolean, error string, train_metric double, test_metric double")
