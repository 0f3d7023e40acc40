"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.scratch import discard, stored


def connected_components(links: DataFrame) -> DataFrame:
    """Per node of ``links`` (a, b): node, component, the smallest node it can reach.

    Each round takes the smallest label among a node's neighbours, then the label of that label, so chains
    shrink by powers of two. Sums are partial before the shuffle, and joins on a node with many links may be split.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("component")), "labels")
    while True:
        reached = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(reached, labels["node"] == reached["a"]).select("node", "component", F.least("component", "near").alias("next"))
        lower = stored(lower, "labels")
        jump = lower.select(F.col("node").alias("at"), F.col("next").alias("further"))
        moved = lower.join(jump, lower["next"] == jump["at"]).select("node", F.col("further").alias("component"), F.expr("further <> component").alias("changed"))
        moved = stored(moved, "labels")
        discard(labels)
        discard(lower)
        labels = moved.select("node", "component")
        if moved.filter("changed").isEmpty():
            discard(both)
            return labels
