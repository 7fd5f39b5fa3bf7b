"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint


def contracted(links: DataFrame) -> DataFrame:
    """links: a, b. Each node's smaller neighbours, and itself, are linked with the least of them instead of with the node,
    which leaves the same components by no more links."""
    pairs = links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct()
    least = pairs.withColumn("least", F.min("low").over(Window.partitionBy("high")))
    turned = least.select("least", F.explode(F.array("high", "low")).alias("a")).filter(F.col("a") != F.col("least"))
    return checkpoint(turned.select("a", F.col("least").alias("b")).distinct())


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). Returns node, component (its smallest node), one row for each node that has a link.

    Each round a node takes the least label among its neighbours' and its own, then its label's label, so that a path of
    n nodes needs about log n rounds. Links and labels stay distributed; each round is checkpointed. Nodes of many links
    are split by Spark's skew handling, as both sides of each join are plain tables, or pre-aggregated. Links are contracted
    beforehand, so that a group with many links to a node joins about one a node.
    """
    pairs = contracted(contracted(links))
    edges = checkpoint(pairs.select("a", "b").union(pairs.select("b", "a")).distinct())
    labels = checkpoint(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")))
    while True:
        seen = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("seen"))
        nearer = checkpoint(
            labels.join(seen, F.col("node") == F.col("a")).select(
                "node", F.least("component", "seen").alias("component"), F.col("component").alias("before")
            )
        )
        target = nearer.select(F.col("node").alias("at"), F.col("component").alias("then"))
        jumped = checkpoint(
            nearer.join(target, F.col("component") == F.col("at")).select("node", F.col("then").alias("component"), "before")
        )
        changed = jumped.filter(F.col("component") != F.col("before")).limit(1).count()
        labels = jumped.select("node", "component")
        if not changed:
            return labels
