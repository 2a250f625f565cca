"""Gradient-boosted trees for a binary label."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fityard.functions.vectors import quoted
from fityard.runtime import new_table_path, shared_dir, written


def fit_gbt(train: DataFrame, seed: int, n_trees: int = 50, max_depth: int = 3,
            learn_rate: float = 0.1, features_col: str = "features", label_col: str = "label",
            **params) -> GBTClassificationModel:
    """Boosting with logistic loss; the label must be 0 or 1.

    Each tree depends on all earlier ones, so lineage is cut every ten trees in the shared folder.
    """
    shared_dir(train.sparkSession)
    return GBTClassifier(featuresCol=features_col, labelCol=label_col, maxIter=n_trees,
                         maxDepth=max_depth, stepSize=learn_rate, lossType="logistic", seed=seed,
                         checkpointInterval=10, **params).fit(train)


def collapsed(df: DataFrame, cols: Sequence[str], weight_col: str = "weight") -> DataFrame:
    """Equal rows once, with their number: a fit with weights gives the same trees, but each of its passes (``max_depth`` by
    tree) is over distinct rows only, which discrete features have few of. Counted in every task before rows move."""
    return written(df.groupBy(*[quoted(c) for c in cols]).agg(F.count("*").cast("double").alias(weight_col)), "distinct-rows")


def importance_table(train: DataFrame, model: GBTClassificationModel,
                     feature_cols: Sequence[str]) -> DataFrame:
    rows = [(c, float(v)) for c, v in
            zip(feature_cols, model.featureImportances.toArray(), strict=True)]
    return train.sparkSession.createDataFrame(rows, "feature string, importance double")


@dataclass(frozen=True)
class Node:
    """Node of a tree ensemble. Children are node numbers of the same tree, -1 for a leaf; rows whose feature is at most
    ``cut`` go left."""

    tree: int
    node: int
    feature: int
    cut: float | None
    left: int
    right: int
    value: float


NODE_SCHEMA = "tree int, node int, feature int, cut double, left int, right int, value double"


def node_table(spark: SparkSession, nodes: Sequence[Node]) -> DataFrame:
    return spark.createDataFrame([(n.tree, n.node, n.feature, n.cut, n.left, n.right, n.value) for n in nodes], NODE_SCHEMA)


def model_nodes(model: GBTClassificationModel, spark: SparkSession) -> DataFrame:
    """The nodes of a fitted ensemble of numeric features, with the rows that were in each (``n``; the sum of their weights, if
    they had any), from the model's own stored form. Depth and number of trees bound the table."""
    path = new_table_path(spark, "trees")
    model.write().save(path)
    stored = spark.read.parquet(f"{path}/data")
    leaf = F.col("n.leftChild") < 0
    return stored.select(F.col("treeID").alias("tree"), F.col("nodeData").alias("n")).select(
        "tree", F.col("n.id").alias("node"), F.when(leaf, -1).otherwise(F.col("n.split.featureIndex")).alias("feature"),
        F.when(~leaf, F.col("n.split.leftCategoriesOrThreshold")[0]).alias("cut"),
        F.col("n.leftChild").alias("left"), F.col("n.rightChild").alias("right"), F.col("n.prediction").alias("value"),
        F.round(F.col("n.impurityStats")[0]).cast("bigint").alias("n"))  # the first statistic of the variance is the weight


def _tree_value(nodes: dict[int, Node], cols: Sequence[str], at: int = 0) -> Column:
    n = nodes[at]
    if n.left < 0:
        return F.lit(float(n.value))
    return F.when(quoted(cols[n.feature]) <= F.lit(float(n.cut)), _tree_value(nodes, cols, n.left)).otherwise(
        _tree_value(nodes, cols, n.right))


def score_trees(df: DataFrame, feature_cols: Sequence[str], nodes: Sequence[Node] | DataFrame,
                weights: Sequence[float]) -> DataFrame:
    """Add ``margin``, the weighted sum of what all trees say, and ``prediction`` (1 above 0).

    Each tree becomes one expression over plain columns, so scoring needs neither a model nor Python. A null feature goes
    right, as nothing compares with it.
    """
    if isinstance(nodes, DataFrame):  # bounded by the ensemble
        nodes = [Node(*row) for row in nodes.select(*Node.__dataclass_fields__).collect()]
    trees: dict[int, dict[int, Node]] = {}
    for n in nodes:
        trees.setdefault(n.tree, {})[n.node] = n
    if sorted(trees) != list(range(len(weights))):
        raise ValueError("every tree needs one weight")
    values = {f"_t{t}": _tree_value(trees[t], feature_cols) for t in trees}
    total = reduce(add, (F.lit(float(w)) * F.col(f"_t{t}") for t, w in enumerate(weights)))
    return (df.withColumns(values).withColumn("margin", total).drop(*values)
            .withColumn("prediction", (F.col("margin") > 0).cast("double")))


def grow_tree(df: DataFrame, feature_cols: Sequence[str], target_col: str, max_depth: int = 3) -> DataFrame:
    """``(node, feature, cut, value, n)`` of one regression tree on discrete features; node 1 is the root, 2 n and 2 n + 1 are
    the children of n. The split of a node is the cut between two neighbouring values that lowers the squared error
    most (ties: lowest feature, lowest cut); leaves have no cut.

    Per level one pass: counts and sums by (node, feature, value), combined in every task first, then running
    totals over the distinct values. Rows never move. Meant for features with a bounded number of values; bin others.
    """
    place, nodes, open_nodes = F.lit(1), [], [1]
    target = quoted(target_col).cast("double")
    for depth in range(max_depth + 1):
        rows = df.select(place.alias("_node"), target.alias("_t"), F.posexplode(F.array(
            *[quoted(c).cast("double") for c in feature_cols])).alias("feature", "value"))
        rows = rows.filter(F.col("_node").isin(open_nodes))
        hist = written(rows.groupBy("_node", "feature", "value").agg(
            F.count("*").alias("_n"), F.sum("_t").alias("_s")), "histogram")
        by_value = Window.partitionBy("_node", "feature").orderBy("value")
        whole = Window.partitionBy("_node", "feature")
        run = hist.select(
            "_node", "feature", "value", F.sum("_n").over(by_value).alias("a"), F.sum("_s").over(by_value).alias("p"),
            F.sum("_n").over(whole).alias("n"), F.sum("_s").over(whole).alias("s"), F.lead("value").over(by_value).alias("after"))
        b, q = F.col("n") - F.col("a"), F.col("s") - F.col("p")
        gain = F.col("p") * F.col("p") / F.col("a") + q * q / b - F.col("s") * F.col("s") / F.col("n")
        best = run.groupBy("_node").agg(
            F.max("n").alias("n"), (F.max_by("s", "n") / F.max("n")).alias("mean"),
            F.min(F.when(b > 0, F.struct((-gain).alias("loss"), "feature", ((F.col("value") + F.col("after")) / 2).alias("cut")))).alias("b"))
        found = best.orderBy("_node").collect()  # at most 2 ** depth rows
        children, moves = [], F.lit(None).cast("int")
        for r in found:
            split = r["b"] if depth < max_depth and r["b"] is not None and r["b"]["loss"] < 0 else None
            nodes.append((r["_node"], split["feature"] if split else -1, split["cut"] if split else None, r["mean"], r["n"]))
            if split:
                right = (quoted(feature_cols[split["feature"]]).cast("double") > F.lit(split["cut"])).cast("int")
                moves = F.when(place == r["_node"], F.lit(2 * r["_node"]) + right).otherwise(moves)
                children += [2 * r["_node"], 2 * r["_node"] + 1]
        if not children:
            break
        place, open_nodes = moves, children
    return df.sparkSession.createDataFrame(nodes, "node int, feature int, cut double, value double, n bigint")
