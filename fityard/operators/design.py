"""Experiment grids: which runs to do, and how many rows each of them finds in the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fityard.spec import DATASETS, LIB_A, LIB_B

# Algorithms, chunk plans (dataset, train chunks, test chunks) and scale-out plans.
ALGORITHMS = ("lr", "kmeans", "pca", "mlp")
PLANS = (
    ("cats_dogs", 70, 12), ("susy", 180, 38),
    ("cats_dogs", 140, 24), ("susy", 360, 76),
    ("cats_dogs", 210, 36), ("susy", 540, 114),
    ("cats_dogs", 280, 48), ("susy", 180, 38),
    ("cats_dogs", 350, 60), ("susy", 360, 76),
    ("cats_dogs", 420, 72), ("susy", 540, 114),
)
SCALING_PLANS = (("cats_dogs", 360, 72), ("cats_dogs", 720, 144), ("cats_dogs", 1080, 216))


def _plan_structs(plans: Sequence[tuple[str, int, int]]) -> Column:
    return F.array(*[
        F.struct(F.lit(i).alias("plan_no"), F.lit(d).alias("plan_dataset"),
                 F.lit(train).alias("train_chunks"), F.lit(test).alias("test_chunks"),
                 F.lit(DATASETS[d].chunk_rows).cast("bigint").alias("chunk_rows"))
        for i, (d, train, test) in enumerate(plans)])


def _with_row_counts(grid: DataFrame) -> DataFrame:
    """Rows the plan asks for, and rows it gets from a table of ``n_rows`` rows."""
    train, test = (F.col(f"{s}_chunks") * F.col("chunk_rows") for s in ("train", "test"))
    return grid.withColumns({
        "train_rows": train, "test_rows": test,
        "train_found": F.least(train, F.col("n_rows")),
        "test_found": F.greatest(F.lit(0), F.least(test, F.col("n_rows") - train)),
    })


def experiment_grid(tables: DataFrame, plans: Sequence[tuple[str, int, int]] = PLANS,
                    algorithms: Sequence[str] = ALGORITHMS,
                    libraries: Sequence[str] = (LIB_A.name, LIB_B.name)) -> DataFrame:
    """One row per algorithm, plan and library. ``tables`` is ``(dataset, n_rows)``."""
    per_plan = tables.select("*", F.inline(_plan_structs(plans))).filter(
        F.col("plan_dataset") == F.col("dataset")).drop("plan_dataset")
    per_algorithm = per_plan.select("*", F.explode(F.array(*map(F.lit, algorithms))).alias("algorithm"))
    grid = per_algorithm.select("*", F.explode(F.array(*map(F.lit, libraries))).alias("library"))
    return _with_row_counts(grid)


def grid_output_name(grid: DataFrame) -> DataFrame:
    """Output name per run, with the number of runs that write to the same name."""
    name = F.concat_ws("_", "dataset", "train_chunks", "test_chunks", "algorithm")
    return (grid.groupBy(name.alias("output_name"))
            .agg(F.count("*").alias("runs"), F.count_distinct("library").alias("libraries"),
                 F.count_distinct("plan_no").alias("plans"))
            .withColumn("collides", F.col("runs") > 1))


def scaling_grid(tables: DataFrame, worker_counts: Sequence[int],
                 plans: Sequence[tuple[str, int, int]] = SCALING_PLANS) -> DataFrame:
    """One row per scale-out plan and number of workers; every model is run in each."""
    per_plan = tables.select("*", F.inline(_plan_structs(plans))).filter(
        F.col("plan_dataset") == F.col("dataset")).drop("plan_dataset")
    workers = F.explode(F.array(*map(F.lit, worker_counts))).alias("workers")
    return _with_row_counts(per_plan.select("*", workers)).withColumn(
        "run_name", F.concat_ws("_", "dataset", "train_chunks", "test_chunks", "workers"))
