"""Principal components, centered and uncentered: the library's fit, and block subspace iteration over the rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import PCA, PCAModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fityard.functions.vectors import dot, quoted
from fityard.operators import moments
from fityard.runtime import written

SWEEP = (10, 20, 30, 40, 50)
# Matrices of n x n doubles are decomposed on the driver; 8,192 columns are 512 MB.
MAX_COLUMNS = 8192
# Up to this width a matrix is one aggregation over plain columns.
MAX_PLAIN_COLUMNS = 24


def fit_pca(train: DataFrame, k: int = 10, features_col: str = "features",
            out: str = "pca_features") -> PCAModel:
    """Top ``k`` components of the centered covariance; ``k`` above the width is an error."""
    return PCA(k=k, inputCol=features_col, outputCol=out).fit(train)


def fix_signs(components: np.ndarray) -> np.ndarray:
    """Flip columns so that the entry of largest magnitude (first on ties) is positive."""
    top = np.argmax(np.abs(components), axis=0)
    signs = np.sign(components[top, np.arange(components.shape[1])])
    return components * np.where(signs == 0, 1.0, signs)


def component_table(spark: SparkSession, components: np.ndarray,
                    ratios: Sequence[float]) -> DataFrame:
    """``(component, dim, loading, ratio, cumulative)`` with fixed signs."""
    fixed, total, rows = fix_signs(components), 0.0, []
    for j, ratio in enumerate(ratios):
        total += float(ratio)
        rows += [(j, i, float(fixed[i, j]), float(ratio), total) for i in range(fixed.shape[0])]
    return spark.createDataFrame(
        rows, "component int, dim int, loading double, ratio double, cumulative double")


def variance_table(spark: SparkSession, ratios: Sequence[float]) -> DataFrame:
    """``(component, ratio, cumulative)``."""
    cumulative = np.cumsum(np.asarray(ratios, dtype=float))
    rows = [(j, float(r), float(c)) for j, (r, c) in enumerate(zip(ratios, cumulative))]
    return spark.createDataFrame(rows, "component int, ratio double, cumulative double")


def _pairs(n: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(n) for j in range(i, n)]


def _long_matrix(df: DataFrame, feature_cols: Sequence[str], cell, out: str) -> DataFrame:
    """One pass over plain columns: upper triangle as aggregates, returned as ``(i, j, out)``."""
    n = len(feature_cols)
    if n > MAX_PLAIN_COLUMNS:
        raise ValueError(f"more than {MAX_PLAIN_COLUMNS} columns: use the vector form")
    cells = df.agg(*[cell(quoted(feature_cols[i]), quoted(feature_cols[j])).alias(f"_{i}_{j}")
                     for i, j in _pairs(n)])
    full = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"),
                 F.col(f"_{min(i, j)}_{max(i, j)}").alias(out))
        for i in range(n) for j in range(n)])
    return cells.select(F.inline(full))


def covariance_matrix(df: DataFrame, feature_cols: Sequence[str]) -> DataFrame:
    """Sample covariance as ``(i, j, cov)`` rows."""
    return _long_matrix(df, feature_cols, F.covar_samp, "cov")


def gram_matrix(df: DataFrame, feature_cols: Sequence[str]) -> DataFrame:
    """Uncentered second moments ``sum(x_i * x_j)`` as ``(i, j, gram)`` rows."""
    return _long_matrix(df, feature_cols, lambda x, y: F.sum(x * y), "gram")


def vector_moments(df: DataFrame, features_col: str = "features") -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, mean and sample covariance of a vector column; missing values count as their column's mean.

    The first pass adds up columns, the second one products of centred values, so a constant column has
    covariance 0 and nothing cancels. n x n numbers reach the driver; :func:`covariance_table` needs none there.
    """
    x = moments.arrays(df, features_col)
    n, mean = moments.column_means(x)
    if len(mean) > MAX_COLUMNS:
        raise ValueError(f"{len(mean)} columns exceed the driver-side limit of {MAX_COLUMNS}")
    total = moments.collected(moments.scatter(x, mean), (len(mean), len(mean)))[0]
    return n, mean, total / max(n - 1, 1)


def covariance_table(df: DataFrame, features_col: str = "features") -> DataFrame:
    """Sample covariance of a vector column of any width as ``(i, j, cov)`` rows, which stay on the executors."""
    x = moments.arrays(df, features_col)
    n, mean = moments.column_means(x)
    return moments.matrix_rows(moments.scatter(x, mean), len(mean), "cov", 1.0 / max(n - 1, 1))


def vector_gram(df: DataFrame, features_col: str = "features") -> np.ndarray:
    """Uncentered second moments of a vector column, imputed."""
    x = moments.arrays(df, features_col)
    mean = moments.column_means(x)[1]
    return moments.collected(moments.scatter(x, mean, centered=False), (len(mean), len(mean)))[0]


def collect_matrix(long: DataFrame, n: int, value_col: str) -> np.ndarray:
    if n > MAX_COLUMNS:
        raise ValueError(f"{n} columns exceed the driver-side limit of {MAX_COLUMNS}")
    matrix = np.zeros((n, n))
    for row in long.collect():
        matrix[row["i"], row["j"]] = row[value_col]
    return matrix


def power_components(gram: np.ndarray, k: int, steps: int | None = None,
                     tol: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Leading ``k`` eigenvectors and eigenvalues of a symmetric matrix, largest eigenvalue first.

    By default from the full decomposition, with signs that make each vector's entries sum to at least 0. With
    ``steps``, by so many steps of power iteration with deflation from the vector of ones; if a ``tol`` above 0 is given
    and a component still moves by more, or isn't an eigenvector to that precision, that is an error.
    """
    n = gram.shape[0]
    if not 1 <= k <= n:
        raise ValueError(f"k must lie between 1 and {n}")
    if not np.isfinite(gram).all():
        raise ValueError("the moments aren't finite; impute or drop missing values first")
    if steps is None:
        values, vectors = np.linalg.eigh(gram)
        vectors, values = vectors[:, ::-1][:, :k], values[::-1][:k]
        return vectors * np.where(vectors.sum(axis=0) < 0, -1.0, 1.0), values
    rest, vectors, values = np.array(gram, dtype=float), [], []
    for _ in range(k):
        v = np.ones(n) / np.sqrt(n)
        for _ in range(steps):
            w = rest @ v
            norm = np.linalg.norm(w)
            if norm == 0.0:
                break
            v, old = w / norm, v
            if tol > 0 and np.linalg.norm(v - old) <= tol:
                break
        value = float(v @ rest @ v)
        if tol > 0 and np.linalg.norm(rest @ v - value * v) > max(tol, 1e-12) * max(np.trace(gram), 1e-300):
            raise ValueError(f"component {len(values)} has not converged after {steps} steps")
        vectors.append(v)
        values.append(value)
        rest = rest - value * np.outer(v, v)
    return np.array(vectors).T, np.array(values)


def fit_components(df: DataFrame, features: str | Sequence[str], k: int = 10, centered: bool = True, tol: float = 1e-11,
                   max_passes: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Leading components (columns) and their shares of the total variance, around the mean or around zero.

    ``features``: a vector column, or plain columns. Missing values count as their column's mean. Rows are written
    once, as arrays; then each pass multiplies them by a few columns, so nothing as large as width x width exists
    anywhere. Passes go on until the components are exact to ``tol`` of the trace.
    """
    x = written(moments.arrays(df, features), "pca-rows")
    _, mean = moments.column_means(x)
    vectors, values, trace = moments.leading_components(moments.product(x, mean, centered), len(mean), k, tol, max_passes)
    return vectors, values / trace if trace > 0 else np.zeros(k)


def fit_pca_uncentered(df: DataFrame, feature_cols: Sequence[str], k: int = 10, **limits) -> tuple[np.ndarray, np.ndarray]:
    """Components and their share of the total (uncentered) variance, plain columns."""
    return fit_components(df, list(feature_cols), k, centered=False, **limits)


def fit_pca_uncentered_vectors(df: DataFrame, k: int = 10, features_col: str = "features",
                               **limits) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`fit_pca_uncentered` for a vector column."""
    return fit_components(df, features_col, k, centered=False, **limits)


def project(df: DataFrame, feature_cols: Sequence[str], components: np.ndarray,
            prefix: str = "pc") -> DataFrame:
    """Raw (uncentered) rows times given components, as plain columns ``pc0``, ``pc1``, ..."""
    return df.select("*", *[dot(components[:, j].tolist(), feature_cols).alias(f"{prefix}{j}")
                            for j in range(components.shape[1])])


def pca_k_sweep(train: DataFrame, ks: Sequence[int] = SWEEP,
                features_col: str = "features") -> DataFrame:
    """``(k, ok, error, explained)`` for each k, from one fit.

    Components are nested: what k components explain is a prefix sum of the largest valid fit. A k
    above the width cannot be fitted and gives ``ok = false``; so do all without rows.
    """
    spark = train.sparkSession
    first = train.select(features_col).first()
    width = 0 if first is None else first[0].size
    valid = [k for k in ks if 1 <= k <= width]
    sums = np.cumsum(fit_components(train, features_col, max(valid))[1]) if valid else []
    rows = [(k, True, None, float(sums[k - 1])) if k in valid
            else (k, False, f"k = {k} does not fit {width} columns", None) for k in ks]
    return spark.createDataFrame(rows, "k int, ok boolean, error string, explained double")
