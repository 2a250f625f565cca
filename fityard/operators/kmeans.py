"""k-means: the library's fit, and Lloyd steps from given centers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.mllib.clustering import KMeans as RddKMeans
from pyspark.mllib.clustering import KMeansModel as RddKMeansModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fityard.functions.vectors import nearest_center, quoted, squared_distance, unit_hash

RUN_TO_CONVERGENCE = 1_000_000
# Odd multipliers of the hashes that choose the first center and the candidates of each round.
SEED_MULTIPLIERS = (3266489917, 2246822519, 668265263, 374761393, 2869860233)


def fit_kmeans(train: DataFrame, seed: int, k: int = 2, max_iter: int = RUN_TO_CONVERGENCE,
               features_col: str = "features", **params) -> KMeansModel:
    """Euclidean k-means, by default until the centers rest."""
    return KMeans(featuresCol=features_col, k=k, maxIter=max_iter, seed=seed, **params).fit(train)


def fit_kmeans_from(train: DataFrame, centers: Sequence[Sequence[float]], max_iter: int = RUN_TO_CONVERGENCE,
                    tol: float = 0.0, features_col: str = "features") -> RddKMeansModel:
    """The library's fit from given centers, which only its RDD form takes: no seed decides where it ends."""
    rows = train.select(vector_to_array(features_col).alias("x")).rdd.map(lambda r: r[0])
    return RddKMeans.train(rows, len(centers), maxIterations=max_iter, epsilon=tol,
                           initialModel=RddKMeansModel([np.array(c, dtype=float) for c in centers]))


def center_table(df: DataFrame, centers: Sequence[Sequence[float]]) -> DataFrame:
    """``(cluster, dim, value)``; clusters are numbered in ascending order of their coordinates."""
    ordered = sorted([float(v) for v in c] for c in centers)
    rows = [(i, d, v) for i, c in enumerate(ordered) for d, v in enumerate(c)]
    return df.sparkSession.createDataFrame(rows, "cluster int, dim int, value double")


def assign_clusters(df: DataFrame, feature_cols: Sequence[str],
                    centers: Sequence[Sequence[float]], out: str = "prediction") -> DataFrame:
    """Nearest of the given centers, lowest number on ties."""
    return df.withColumn(out, nearest_center(centers, feature_cols))


def seed_centers(df: DataFrame, feature_cols: Sequence[str], key: str, k: int, rounds: int = 2) -> list[list[float]]:
    """``k`` starting centers by parallel seeding with squared distances, the same for any partitioning.

    The row of the smallest hash of the integer ``key`` comes first. In each round every row becomes a candidate with
    probability 2 k times its share of all squared distances to the candidates so far; a hash of the key decides.
    So a round is two passes, and about 2 k rows reach the driver. Candidates are weighed by the rows nearest to them; the
    heaviest is the first center, and each further one has the largest weight times squared distance to the centers before.
    """
    if not 1 <= rounds < len(SEED_MULTIPLIERS):
        raise ValueError(f"rounds must lie between 1 and {len(SEED_MULTIPLIERS) - 1}")
    x = F.array(*[quoted(c).cast("double") for c in feature_cols])
    first = df.agg(F.min(F.struct(unit_hash(key, SEED_MULTIPLIERS[0]).alias("h"), x.alias("x"))).alias("m")).first()["m"]
    if first is None:
        raise ValueError("there are no rows")
    candidates = [list(first["x"])]

    def nearest() -> Column:
        distances = [squared_distance(c, feature_cols) for c in candidates]
        return F.least(*distances) if len(distances) > 1 else distances[0]

    for r in range(1, rounds + 1):
        total = df.agg(F.sum(nearest())).first()[0]
        if not total:
            break
        chosen = df.filter(unit_hash(key, SEED_MULTIPLIERS[r]) < nearest() * F.lit(2.0 * k / total)).select(x.alias("x")).distinct()
        candidates += sorted(list(row["x"]) for row in chosen.collect())
    counts = {r["_c"]: r["count"] for r in assign_clusters(df, feature_cols, candidates, "_c").groupBy("_c").count().collect()}
    weight = np.array([counts.get(i, 0) for i in range(len(candidates))], dtype=float)
    points = np.array(candidates)
    if (weight > 0).sum() < k:
        raise ValueError(f"there are fewer than {k} candidates; more rounds, or a smaller k")
    chosen = [int(np.argmax(weight))]
    while len(chosen) < k:
        far = np.square(points[:, None] - points[None, chosen]).sum(axis=2).min(axis=1)
        chosen.append(int(np.argmax(weight * far)))
    return [candidates[i] for i in chosen]


def fit_kmeans_seeded(df: DataFrame, feature_cols: Sequence[str], key: str, k: int = 2, rounds: int = 2,
                      tol: float = 1e-12, max_steps: int = RUN_TO_CONVERGENCE) -> list[list[float]]:
    """Centers of plain columns: :func:`seed_centers`, then Lloyd steps until no coordinate moves by more than ``tol``."""
    return kmeans_lloyd(df, feature_cols, seed_centers(df, feature_cols, key, k, rounds), max_steps, tol)


def kmeans_lloyd(df: DataFrame, feature_cols: Sequence[str], centers: Sequence[Sequence[float]],
                 steps: int, tol: float = 0.0) -> list[list[float]]:
    """Centers after ``steps`` Lloyd steps (fewer if they move by ``tol`` at most).

    A step is one aggregation with map-side combining; what reaches the driver is k rows of sums. A
    cluster that loses all its rows keeps its center.
    """
    points = df.select(*[quoted(c) for c in feature_cols]).persist(StorageLevel.MEMORY_AND_DISK)
    current = [[float(v) for v in c] for c in centers]
    try:
        for _ in range(steps):
            means = (assign_clusters(points, feature_cols, current, "_cluster")
                     .groupBy("_cluster")
                     .agg(*[F.avg(quoted(c)).alias(f"_m{i}") for i, c in enumerate(feature_cols)])
                     .collect())
            moved = [list(c) for c in current]
            for row in means:
                moved[row["_cluster"]] = [row[f"_m{i}"] for i in range(len(feature_cols))]
            rested = np.abs(np.subtract(moved, current)).max() <= tol
            current = moved
            if rested:
                break
    finally:
        points.unpersist()
    return current


def _partial_means(centers: np.ndarray):
    """Per task: number of rows and mean of the rows nearest to each center."""

    def fn(batches):
        n, sums = np.zeros(len(centers)), np.zeros(centers.shape)
        for batch in batches:
            if batch.empty:
                continue
            x = np.stack(batch["x"].to_numpy())
            # One center at a time keeps the scratch memory at the size of the batch.
            nearest = np.argmin([np.square(x - c).sum(axis=1) for c in centers], axis=0)
            for j in np.unique(nearest):
                mine = x[nearest == j]
                n[j] += len(mine)
                sums[j] += mine.sum(axis=0)
        held = np.flatnonzero(n)
        if not held.size:  # a task without rows: pandas would have no lists to tell the column's type from
            return
        yield pd.DataFrame({"cluster": held, "n": n[held], "mean": list(sums[held] / n[held, None])})

    return fn


def kmeans_lloyd_vectors(df: DataFrame, centers: Sequence[Sequence[float]], steps: int,
                         features_col: str = "features") -> list[list[float]]:
    """As :func:`kmeans_lloyd` for a vector column, whose width would be too much for expressions.

    Each task sends one weighted mean per cluster; Spark combines them.
    """
    points = df.select(vector_to_array(features_col).alias("x")).persist(StorageLevel.MEMORY_AND_DISK)
    current = np.array(centers, dtype=float)
    try:
        for _ in range(steps):
            parts = points.mapInPandas(_partial_means(current), "cluster int, n double, mean array<double>")
            mean = Summarizer.mean(array_to_vector("mean"), F.col("n")).alias("mean")
            moved = current.copy()
            for row in parts.groupBy("cluster").agg(mean).collect():
                moved[row["cluster"]] = row["mean"].toArray()
            if np.array_equal(moved, current):
                break
            current = moved
    finally:
        points.unpersist()
    return current.tolist()
