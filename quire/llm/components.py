"""Connected components of an edge table, by least labels with shortcuts; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b); component is the least node.  Every round takes the least
    label among neighbours, then the label's own label, so the rounds are about the logarithm of the longest path."""
    ways = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))
    both = materialize(edges.select(F.inline(ways)).distinct(), "edges")
    labels = materialize(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("near"))
        met = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("now"))
        hop = labels.select(F.col("node").alias("now"), F.col("component").alias("next"))
        step = materialize(met.join(hop, "now", "left").select("node", "old", F.least("now", "next").alias("component")), "labels")
        labels = step.select("node", "component")
        if step.where("old != component").isEmpty():
            return labels
