"""Exact model metrics as distributed aggregates.

Ordered metrics (ROC, AUC, best threshold) read the scored rows once, into a written table of label
counts per distinct score. Its scores are cut into buckets; running totals are kept per bucket and
shifted by the totals of the buckets before, so no task ever sorts more than one bucket.
"""

from __future__ import annotations

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fityard.functions.ordering import score_buckets
from fityard.functions.vectors import quoted
from fityard.runtime import written

PROBABILITY_FLOOR = 1e-15


def hit(prediction_col: str = "prediction", label_col: str = "label") -> Column:
    """1 where prediction and label agree, else 0 (also when either is null)."""
    return F.coalesce((quoted(prediction_col) == quoted(label_col)).cast("int"), F.lit(0))


def accuracy(df: DataFrame, prediction_col: str = "prediction", label_col: str = "label",
             by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.avg(hit(prediction_col, label_col)).alias("accuracy"))


def hit_rate(df: DataFrame, prediction_col: str = "prediction", label_col: str = "label") -> DataFrame:
    hits = F.sum(hit(prediction_col, label_col))
    return df.agg(hits.alias("hits"), F.count("*").alias("n"),
                  (hits / F.count("*")).alias("hit_rate"))


def confusion_matrix(df: DataFrame, prediction_col: str = "prediction",
                     label_col: str = "label") -> DataFrame:
    return (df.groupBy(quoted(label_col).alias("label"), quoted(prediction_col).alias("prediction"))
            .agg(F.count("*").alias("n")))


def _score_table(df: DataFrame, score_col: str, label_col: str, *sums: Column) -> DataFrame:
    """Written table per distinct score: its positives ``p``, negatives ``q`` and further sums."""
    positive = (quoted(label_col) == 1).cast("bigint")
    per_score = df.groupBy(quoted(score_col).alias("score")).agg(
        F.sum(positive).alias("p"), F.sum(1 - positive).alias("q"), *sums)
    return written(per_score, "scores")


def _running_counts(scores: DataFrame) -> DataFrame:
    """Add the positives ``cum_p`` and negatives ``cum_q`` with a score at least as high, and the
    totals ``all_p`` and ``all_q``."""
    bucketed = score_buckets(scores.select("score", "p", "q"), "score")
    # One row per bucket, that is for each BUCKET_ROWS distinct scores: 40 MB at 10^12 of them.
    higher = Window.orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    shifts = (bucketed.groupBy("_bucket").agg(F.sum("p").alias("_bp"), F.sum("q").alias("_bq"))
              .select("_bucket",
                      F.coalesce(F.sum("_bp").over(higher), F.lit(0)).alias("_hp"),
                      F.coalesce(F.sum("_bq").over(higher), F.lit(0)).alias("_hq"),
                      F.sum("_bp").over(everything).alias("all_p"),
                      F.sum("_bq").over(everything).alias("all_q")))
    within = (Window.partitionBy("_bucket").orderBy(F.desc("score"))
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = bucketed.select("*", F.sum("p").over(within).alias("_lp"),
                            F.sum("q").over(within).alias("_lq"))
    return local.join(F.broadcast(shifts), "_bucket").select(
        "score", "p", "q", (F.col("_lp") + F.col("_hp")).alias("cum_p"),
        (F.col("_lq") + F.col("_hq")).alias("cum_q"), "all_p", "all_q")


def roc_curve(df: DataFrame, score_col: str = "margin", label_col: str = "label") -> DataFrame:
    """All points ``(threshold, fpr, tpr)``, one per distinct score; predict 1 at or above it."""
    return _running_counts(_score_table(df, score_col, label_col)).select(
        F.col("score").alias("threshold"),
        (F.col("cum_q") / F.col("all_q")).alias("fpr"),
        (F.col("cum_p") / F.col("all_p")).alias("tpr"))


def _auc(scores: DataFrame) -> DataFrame:
    below = F.col("all_q") - F.col("cum_q")
    won = F.sum(F.col("p") * (below.cast("double") + F.col("q") / 2))
    pairs = F.max(F.col("all_p").cast("double") * F.col("all_q"))
    return _running_counts(scores).agg((won / pairs).alias("auc"))


def auc(df: DataFrame, score_col: str = "margin", label_col: str = "label") -> DataFrame:
    """Exact area under the ROC curve; tied scores count half."""
    return _auc(_score_table(df, score_col, label_col))


def best_threshold_accuracy(df: DataFrame, score_col: str = "margin",
                            label_col: str = "label") -> DataFrame:
    """Highest accuracy over all thresholds, with the smallest threshold that reaches it."""
    correct = F.col("cum_p") + F.col("all_q") - F.col("cum_q")
    best = F.max(F.struct(correct.alias("hits"), (-F.col("score")).alias("neg"),
                          (F.col("all_p") + F.col("all_q")).alias("n")))
    return (_running_counts(_score_table(df, score_col, label_col)).agg(best.alias("b"))
            .select((-F.col("b.neg")).alias("threshold"),
                    (F.col("b.hits") / F.col("b.n")).alias("accuracy")))


def model_performance(df: DataFrame, probability_col: str = "probability",
                      prediction_col: str = "prediction", label_col: str = "label",
                      score_col: str = "margin") -> DataFrame:
    """One row: rows, accuracy, AUC, log-loss and root mean squared error."""
    p = F.greatest(F.lit(PROBABILITY_FLOOR),
                   F.least(F.lit(1 - PROBABILITY_FLOOR), quoted(probability_col)))
    y, error = quoted(label_col), quoted(label_col) - quoted(probability_col)
    scores = _score_table(
        df, score_col, label_col, F.count("*").alias("n"),
        F.sum(hit(prediction_col, label_col)).alias("hits"),
        F.sum(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("loss"),
        F.sum(error * error).alias("sq"))
    n = F.sum("n")
    sums = scores.agg(n.alias("n"), (F.sum("hits") / n).alias("accuracy"),
                      (F.sum("loss") / n).alias("log_loss"), F.sqrt(F.sum("sq") / n).alias("rmse"))
    # Two one-row results, laid side by side.
    both = sums.unionByName(_auc(scores), allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in ("n", "accuracy", "log_loss", "rmse", "auc")])


def silhouette(df: DataFrame, features_col: str = "features",
               prediction_col: str = "prediction") -> DataFrame:
    """Mean silhouette under squared Euclidean distance, from per-cluster sums (no pairs)."""
    value = ClusteringEvaluator(featuresCol=features_col, predictionCol=prediction_col).evaluate(df)
    return df.sparkSession.createDataFrame([(float(value),)], "silhouette double")


def cluster_label_agreement(df: DataFrame, prediction_col: str = "prediction",
                            label_col: str = "label") -> DataFrame:
    """Share of rows whose cluster number equals the label, as numbered and under the better of the
    two numberings (k = 2)."""
    as_is = F.avg(hit(prediction_col, label_col))
    swapped = F.avg(F.coalesce(
        ((1 - quoted(prediction_col)) == quoted(label_col)).cast("int"), F.lit(0)))
    return df.agg(F.count("*").alias("n"), as_is.alias("agreement"),
                  F.greatest(as_is, swapped).alias("best_agreement"))


def cluster_label_crosstab(df: DataFrame, clusters: list[int], prediction_col: str = "prediction",
                           label_col: str = "label") -> DataFrame:
    """Rows per label and cluster, one column ``cluster_<c>`` per cluster."""
    return df.groupBy(quoted(label_col).alias("label")).agg(*[
        F.sum((quoted(prediction_col) == c).cast("bigint")).alias(f"cluster_{c}") for c in clusters])


def model_comparison(df: DataFrame, predictions: dict[str, str],
                     label_col: str = "label") -> DataFrame:
    """Accuracy of several predictions that stand on the same rows, side by side in one pass."""
    return df.agg(F.count("*").alias("n"), *[
        F.avg(hit(col, label_col)).alias(f"{name}_accuracy") for name, col in predictions.items()])
