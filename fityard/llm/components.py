"""Connected components of a table of links, by shuffles only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fityard.runtime import written


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links`` (a, b: integers); component is the smallest node
    that can be reached.

    Each round gives every node the smallest label among itself and its neighbours, then the label of its
    label, until nothing changes. Labels are written to the shared folder once a round, so that a lost
    executor costs no more than the running round. Minima are combined before the shuffle, so a node with
    very many neighbours is no hot key.
    """
    both = written(links.filter("a != b").select("a", "b").unionByName(
        links.filter("a != b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component"))
                     .withColumnRenamed("a", "node"), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), "component"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near")))
        nearest = labels.join(near, "node").select(
            "node", F.col("component").alias("was"), F.least("component", "near").alias("label"))
        of_label = labels.select(F.col("node").alias("label"), F.col("component").alias("further"))
        step = written(nearest.join(of_label, "label", "left").select(
            "node", F.coalesce(F.least("label", "further"), "label").alias("component"),
            (F.coalesce(F.least("label", "further"), "label") != F.col("was")).alias("moved")), "labels")
        labels = step.select("node", "component")
        if step.filter("moved").isEmpty():
            return labels
