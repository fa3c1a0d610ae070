"""Connected components of a graph given as stars, by least-label propagation with shortcuts, in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.llm.common import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the least node reachable. Self-edges and repeats are harmless.

    Each round gives a node the least label among itself, its neighbours and its label's own label, so chains shorten by
    jumps. A round is written to the shared folder, which cuts the lineage; it ends when no label fell.
    Hub nodes are safe: labels are pre-aggregated before they are shuffled, and joins may be split by adaptive execution.
    """
    both = materialise(edges.select("a", "b").where("a <> b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        moved = (labels.join(near, "node").join(jump, "label", "left")
                 .select("node", F.least("label", "near", F.coalesce("far", "label")).alias("label"), F.col("label").alias("old")))
        moved = materialise(moved, "labels")
        labels = moved.select("node", "label")
        if moved.where("label < old").isEmpty():
            return labels.withColumnRenamed("label", "component")
