"""Logistic regression: plain and elastic-net fits, scoring with a model or with given weights."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fityard.functions.vectors import dot
from fityard.operators import moments
from fityard.runtime import written


def fit_logreg(train: DataFrame, max_iter: int = 50, features_col: str = "features",
               label_col: str = "label", **params) -> LogisticRegressionModel:
    """Binary logistic regression without penalty."""
    return LogisticRegression(featuresCol=features_col, labelCol=label_col, maxIter=max_iter,
                              family="binomial", **params).fit(train)


def fit_elastic_net(train: DataFrame, reg_param: float, mix: float = 0.5, max_iter: int = 50,
                    features_col: str = "features", label_col: str = "label",
                    **params) -> LogisticRegressionModel:
    """Binomial model with penalty ``reg_param * (mix * |w|_1 + (1 - mix) / 2 * |w|_2^2)``."""
    return LogisticRegression(featuresCol=features_col, labelCol=label_col, maxIter=max_iter,
                              family="binomial", regParam=reg_param, elasticNetParam=mix,
                              **params).fit(train)


@dataclass(frozen=True)
class NewtonFit:
    """Weights of an unpenalised fit, how many steps it took, and the largest mean gradient that is left."""

    intercept: float
    coefficients: list[float]
    steps: int
    gradient: float


def fit_logreg_newton(train: DataFrame, features: str | Sequence[str], label_col: str = "label", tol: float = 1e-10,
                      max_steps: int = 50) -> NewtonFit:
    """Binary logistic regression without penalty by Newton steps, exact to ``tol`` in the mean gradient.

    ``features``: a vector column or plain columns, without missing values. A step is one pass: every task gives the
    gradient and the Hessian of its rows, Spark adds them up, and (width + 1) squared numbers reach the driver. A step
    that raises the loss is halved. Classes that can be parted, linearly dependent features and an end without
    convergence are errors.
    """
    rows = train.select("*", F.col(label_col).cast("double").alias("_label"))
    x = written(moments.arrays(rows, features, "_label"), "newton-rows")
    n = moments.width_of(x) + 1

    def at(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, float]:
        sent = train.sparkSession.sparkContext.broadcast(beta)

        def work(batches):
            b, total, loss, count = sent.value, np.zeros((n, n + 1)), 0.0, 0
            for batch in batches:
                m = np.hstack([np.ones((batch.num_rows, 1)), moments.rows_of(batch.column(0), n - 1)])
                y = np.asarray(batch.column(1), dtype=float)
                z = m @ b
                p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                total[:, :n] += (m * (p * (1 - p))[:, None]).T @ m
                total[:, n] += m.T @ (y - p)
                loss += float((np.logaddexp(0.0, z) - y * z).sum())
                count += len(y)
            return total, [loss, count]

        total, more = moments.collected(moments.summed(x, work), (n, n + 1))
        sent.destroy()
        if not np.isfinite(total).all():
            raise ValueError("features or labels have missing or infinite values")
        return float(more[0]), total[:, n], total[:, :n], float(more[1])

    beta, size = np.zeros(n), 1.0
    loss, gradient, hessian, count = at(beta)
    for step in range(max_steps):
        worst = float(np.abs(gradient).max() / count)
        if loss <= 1e-7 * count or np.linalg.cond(hessian) > 1e14:
            raise ValueError("the classes can be parted, or features depend on each other: no unique optimum")
        if worst <= tol:
            return NewtonFit(float(beta[0]), beta[1:].tolist(), step, worst)
        move, size = np.linalg.solve(hessian, gradient), 1.0
        new = at(beta + move)
        while new[0] > loss + 1e-9 * max(abs(loss), 1.0):
            size /= 2
            if size < 1e-6:
                raise ValueError("no step lowers the loss")
            new = at(beta + size * move)
        beta, (loss, gradient, hessian, count) = beta + size * move, new
    raise ValueError(f"the fit has not converged after {max_steps} steps")


def coefficient_table(train: DataFrame, model: LogisticRegressionModel,
                      feature_cols: Sequence[str]) -> DataFrame:
    """``(term, value)``: the intercept and one row per feature."""
    rows = [("intercept", float(model.intercept))]
    rows += [(c, float(w)) for c, w in zip(feature_cols, model.coefficients.toArray(), strict=True)]
    return train.sparkSession.createDataFrame(rows, "term string, value double")


def with_margin(scored: DataFrame, raw_col: str = "rawPrediction", out: str = "margin") -> DataFrame:
    """Log-odds of the positive class of a logistic model, which do not saturate as probabilities do."""
    return scored.withColumn(out, vector_to_array(F.col(raw_col))[1])


def score_weights(df: DataFrame, feature_cols: Sequence[str], weights: Sequence[float],
                  intercept: float, threshold: float = 0.5) -> DataFrame:
    """Add ``margin``, ``probability`` and ``prediction`` for given weights, inside codegen."""
    margin = dot(weights, feature_cols, intercept)
    return (df.withColumn("margin", margin)
            .withColumn("probability", 1 / (1 + F.exp(-F.col("margin"))))
            .withColumn("prediction", (F.col("probability") > threshold).cast("double")))
