"""Comparing the runs of two libraries: pairing, parity, setup, times and accuracies.

``runs`` is ``(run_id, library)``. The i-th run of one library is paired with the i-th run of the
other; ``pairs`` is ``(pair_idx, run_id, library)`` with two rows per pair. Two-sided tables are
built by conditional aggregation on the pair instead of joining the sides, so they need one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fityard.functions.ordering import BLOCK_ROWS, index_within
from fityard.runtime import join_lookup, written
from fityard.spec import LIB_A, LIB_B

# The two kinds of result that can be compared, and the metrics under each.
METRICS = {"Runtime(Sec)": ("setup_us", "train_us", "test_us"), "Accuracy": ("train_acc", "test_acc")}


def _side(library: str, value: str) -> Column:
    return F.max(F.when(F.col("library") == library, F.col(value)))


def pair_runs(runs: DataFrame, lib_a: str = LIB_A.name, lib_b: str = LIB_B.name,
              block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(pair_idx, run_a, run_b)``; runs beyond the shorter side have no partner and are left out."""
    wanted = runs.filter(F.col("library").isin(lib_a, lib_b)).select("library", "run_id")
    placed = index_within(wanted, ["library"], ["run_id"], "pair_idx", block_rows)
    return (placed.groupBy("pair_idx")
            .agg(_side(lib_a, "run_id").alias("run_a"), _side(lib_b, "run_id").alias("run_b"))
            .filter(F.col("run_a").isNotNull() & F.col("run_b").isNotNull()))


def pair_members(pairs: DataFrame, lib_a: str = LIB_A.name, lib_b: str = LIB_B.name) -> DataFrame:
    """Two rows ``(pair_idx, run_id, library)`` per pair."""
    sides = F.array(F.struct(F.col("run_a").alias("run_id"), F.lit(lib_a).alias("library")),
                    F.struct(F.col("run_b").alias("run_id"), F.lit(lib_b).alias("library")))
    return pairs.select("pair_idx", F.inline(sides))


def _in_pairs(rows: DataFrame, members: DataFrame) -> DataFrame:
    return rows.join(members.select("pair_idx", "run_id"), "run_id")


def check_model_parity(models: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per pair: trainings on both sides, whether they are equally many, and names one side lacks.

    ``models`` is ``(run_id, model)`` with repeats, as ``run_models`` returns it.
    """
    a = F.col("run_id") == F.col("run_a")
    by_run = models.groupBy("run_id", "model").agg(F.count("*").alias("_n"))
    sides = F.array(F.col("run_a"), F.col("run_b"))
    members = pairs.select("*", F.explode(sides).alias("run_id"))
    # Kept from the left so that a pair without any training still has its row.
    named = (members.join(by_run, "run_id", "left").groupBy("pair_idx", "run_a", "run_b", "model")
             .agg(F.coalesce(F.sum(F.when(a, F.col("_n"))), F.lit(0)).alias("_a"),
                  F.coalesce(F.sum(F.when(~a, F.col("_n"))), F.lit(0)).alias("_b")))
    one_sided = ((F.col("_a") == 0) != (F.col("_b") == 0)).cast("bigint")
    return named.groupBy("pair_idx", "run_a", "run_b").agg(
        F.sum("_a").alias("models_a"), F.sum("_b").alias("models_b"),
        (F.sum("_a") == F.sum("_b")).alias("same_count"),
        F.sum(one_sided).alias("one_sided_models"))


def setup_comparison(setup: DataFrame, members: DataFrame, lib_a: str = LIB_A.name,
                     lib_b: str = LIB_B.name) -> DataFrame:
    """Setup events of either side per pair, 0 where a side lacks one; ``ord`` puts common events
    first, then one-sided ones, each in name order."""
    sides = (_in_pairs(setup, members).groupBy("pair_idx", "event")
             .agg(_side(lib_a, "setup_us").alias("a"), _side(lib_b, "setup_us").alias("b")))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    # A pair has at most as many names as there are setup positions in the two profiles.
    order = Window.partitionBy("pair_idx").orderBy(F.desc("both_present"), "event")
    return (sides.withColumn("both_present", both)
            .select("pair_idx", "event", "both_present",
                    F.coalesce("a", F.lit(0)).alias("a_us"), F.coalesce("b", F.lit(0)).alias("b_us"),
                    (F.row_number().over(order) - 1).alias("ord")))


def setup_stack(comparison: DataFrame) -> DataFrame:
    """Add the base of each stacked bar: the sum of the pair's earlier setup events."""
    before = (Window.partitionBy("pair_idx").orderBy("ord")
              .rowsBetween(Window.unboundedPreceding, -1))
    return comparison.select("*", *[
        F.coalesce(F.sum(f"{s}_us").over(before), F.lit(0)).alias(f"{s}_base_us") for s in "ab"])


def setup_by_dimension(setup: DataFrame, members: DataFrame, dimensions: DataFrame, lib_a: str = LIB_A.name,
                       lib_b: str = LIB_B.name) -> DataFrame:
    """Stacked setup times over a dimension: ``(dimension, event, both_present, a_s, b_s, ord, a_base_s, b_base_s)``.

    Per dimension value and setup event the mean seconds over the runs of each library, 0 where it has none. Events that both
    libraries log, in any run, are at the bottom, in name order, then those of one library; a bar's base is the sum of
    the bars below it. ``dimensions`` is ``(run_id, dimension)``.
    """
    rows = _in_pairs(setup, members).join(dimensions.select("run_id", "dimension"), "run_id")
    # One row per name of a setup event, of which a library profile has a handful.
    names = written(rows.groupBy("event").agg(
        (F.max((F.col("library") == lib_a).cast("int")) + F.max((F.col("library") == lib_b).cast("int")) == 2)
        .alias("both_present")), "setup-events")

    def mean(lib):
        return F.coalesce(F.avg(F.when(F.col("library") == lib, F.col("setup_us"))) / F.lit(1e6), F.lit(0.0))

    bars = join_lookup(rows.groupBy("dimension", "event").agg(mean(lib_a).alias("a_s"), mean(lib_b).alias("b_s")), names, ["event"])
    order = Window.partitionBy("dimension").orderBy(F.desc("both_present"), "event")
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    return bars.select("dimension", "event", "both_present", "a_s", "b_s", (F.row_number().over(order) - 1).alias("ord"), *[
        F.coalesce(F.sum(f"{s}_s").over(below), F.lit(0.0)).alias(f"{s}_base_s") for s in "ab"])


def _sides_of(summary: DataFrame, members: DataFrame, values: list[str], lib_a: str,
              lib_b: str) -> DataFrame:
    """Models that both runs of a pair have, with ``<value>_a`` and ``<value>_b``."""
    return (_in_pairs(summary, members).groupBy("pair_idx", "model")
            .agg(F.count("*").alias("_n"),
                 *[_side(lib, v).alias(f"{v}_{s}") for v in values
                   for s, lib in (("a", lib_a), ("b", lib_b))])
            .filter(F.col("_n") == 2).drop("_n"))


def model_time_comparison(summary: DataFrame, members: DataFrame, lib_a: str = LIB_A.name,
                          lib_b: str = LIB_B.name) -> DataFrame:
    """Training and testing time of both sides per pair and model."""
    return _sides_of(summary, members, ["train_us", "test_us"], lib_a, lib_b)


def model_accuracy_comparison(summary: DataFrame, members: DataFrame, lib_a: str = LIB_A.name,
                              lib_b: str = LIB_B.name) -> DataFrame:
    """Accuracies of both sides, left out where their product is 1 (so also where all are -1)."""
    sides = _sides_of(summary, members, ["train_acc", "test_acc"], lib_a, lib_b)
    product = (F.col("train_acc_a") * F.col("train_acc_b")
               * F.col("test_acc_a") * F.col("test_acc_b"))
    return sides.filter(product != 1.0)


def _as_value(metric: str) -> Column:
    """Times in seconds, accuracies as they are; -1 marks a missing value in both."""
    if not metric.endswith("_us"):
        return F.col(metric)
    return F.when(F.col(metric) < 0, F.lit(-1.0)).otherwise(F.col(metric) / 1e6)


def long_metrics(summary: DataFrame) -> DataFrame:
    """``(run_id, library, model, result_type, metric, value)`` from a run summary;
    runs without a model have none."""
    cells = F.array(*[
        F.struct(F.lit(kind).alias("result_type"), F.lit(m).alias("metric"),
                 _as_value(m).alias("value"))
        for kind, metrics in METRICS.items() for m in metrics])
    return summary.filter("model is not null").select("run_id", "library", "model", F.inline(cells))


def select_metric(metrics: DataFrame, result_type: str) -> DataFrame:
    """Rows of one of the two result types; any other name is an error."""
    if result_type not in METRICS:
        raise ValueError(f"result type must be one of {sorted(METRICS)}")
    return metrics.filter(F.col("result_type") == result_type)


def dimension_comparison(metrics: DataFrame, dimensions: DataFrame, lib_a: str = LIB_A.name,
                         lib_b: str = LIB_B.name) -> DataFrame:
    """Per model, metric and dimension value the mean over the runs of each library, side by side.

    Failed runs carry a negative marker instead of a value: they are counted (``failures_a``, ``failures_b``) and
    left out of the mean, which is -1 only if all runs of the library have failed.

    ``dimensions`` is ``(run_id, dimension)``, for example the number of training rows or workers.
    """
    def mean(lib):
        own = F.col("library") == lib
        return F.coalesce(F.avg(F.when(own & (F.col("value") >= 0), F.col("value"))),
                          F.max(F.when(own & (F.col("value") < 0), F.lit(-1.0))))

    def failures(lib):
        return F.count(F.when((F.col("library") == lib) & (F.col("value") < 0), True))

    return (metrics.join(dimensions.select("run_id", "dimension"), "run_id")
            .groupBy("model", "result_type", "metric", "dimension")
            .agg(mean(lib_a).alias("value_a"), mean(lib_b).alias("value_b"),
                 failures(lib_a).alias("failures_a"), failures(lib_b).alias("failures_b")))


def interleaved_series(members: DataFrame, dimensions: DataFrame, short_names: dict[str, str]) -> DataFrame:
    """Order of bars over a dimension: each value's first library, then its second one.

    ``pair_idx`` is the position of the dimension value, so the place is plain arithmetic.
    """
    libs = list(short_names)
    lib_pos = F.coalesce(*[F.when(F.col("library") == lib, F.lit(i)) for i, lib in enumerate(libs)])
    short = F.coalesce(*[F.when(F.col("library") == lib, F.lit(s)) for lib, s in short_names.items()])
    return (members.join(dimensions.select("run_id", "dimension"), "run_id")
            .select((F.col("pair_idx") * len(libs) + lib_pos).alias("series_pos"),
                    F.concat_ws("_", F.col("dimension").cast("string"), short).alias("label"),
                    "run_id"))


def check_dimension_arity(runs: DataFrame, dimension_values: DataFrame, lib_a: str = LIB_A.name,
                          lib_b: str = LIB_B.name) -> DataFrame:
    """One row: logs of each library, dimension values, and whether all three agree."""
    counted = runs.select("library").unionByName(
        dimension_values.select(F.lit(None).cast("string").alias("library")))

    def of(lib):
        return F.count(F.when(F.col("library") == lib, F.lit(1)))

    values = F.count(F.when(F.col("library").isNull(), F.lit(1)))
    return counted.agg(of(lib_a).alias("logs_a"), of(lib_b).alias("logs_b"),
                       values.alias("n_dimensions")).withColumn(
        "ok", (F.col("logs_a") == F.col("logs_b")) & (F.col("logs_a") == F.col("n_dimensions")))
