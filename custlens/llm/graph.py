"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlens.functions.stages import written


def components(edges: DataFrame) -> DataFrame:
    """For every node of ``edges`` (a, b), the smallest node that it is connected with: node, label.

    Every round, each node takes the smallest label among itself and its neighbours, and then the label of that label, so
    that the rounds grow with the logarithm of a chain's length. Labels are written each round and neighbours' labels are
    merged before the shuffle; a node with very many neighbours is split by the adaptive skew join.
    """
    both = edges.select("a", "b").where("a <> b")
    both = written(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select(
        "node", F.least("node", "b").alias("label")), "labels")
    while True:
        told = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("told"))
        near = labels.join(told, "node").select("node", F.least("label", "told").alias("label"), F.col("label").alias("old"))
        near = written(near, "labels_near")
        jump = near.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = written(near.join(jump, "label").select("node", F.least("label", "further").alias("label"), "old"), "labels")
        changed = new.where("label <> old").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
