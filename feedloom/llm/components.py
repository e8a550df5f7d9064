"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import stage


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of `links` (a, b): label is the smallest node reachable.

    In a round every node takes the smallest label among its own and its neighbours', then the
    label of that label, so labels travel at least twice as far each time. The rounds end
    when no label changes. All of it is joins and aggregates on tables; a round's result
    is written, so that a lost executor costs one round at most.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stage(both.where("a != b").distinct(), "links")
    labels = stage(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")),
        "labels",
    )
    while True:
        # Of all neighbours' labels, one per node and task is sent.
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        nearest = labels.join(near, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        nearest = stage(nearest, "nearest")
        roots = nearest.select(F.col("node").alias("label"), F.col("label").alias("root"))
        labels = stage(
            nearest.join(roots, "label").select("node", "old", F.least("label", "root").alias("label")),
            "labels",
        )
        if labels.where("old != label").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
