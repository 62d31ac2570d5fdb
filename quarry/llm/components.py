"""Connected components of an edge table, by label propagation with short cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import written


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, label) for every node of edges (a, b): label is the smallest node of its component.

    Each round gives a node the smallest label around it and then that label's own label, so long chains shrink
    quickly. Labels live in written tables; only the number of changes comes to the driver.
    """
    both = written(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges"
    )
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    for _ in range(rounds):
        near = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        )
        step = labels.join(near, "node", "left").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        moved = written(
            step.join(jump, "label", "left").select("node", "old", F.least("label", "far").alias("label")), "labels"
        )
        changes = moved.where("label <> old").limit(1).count()
        labels = moved.select("node", "label")
        if not changes:
            return labels
    raise RuntimeError(f"components have not settled in {rounds} rounds")
