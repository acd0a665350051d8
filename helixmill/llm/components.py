"""Connected components of links between records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.session import cut_lineage

#: Rounds after which the labels must have settled; each round at least doubles the reach of a label.
MAX_ROUNDS = 40


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of ``links``; the component is its smallest node.

    Every node takes the smallest label among its neighbours and then the label
    of its label.  Labels stay in the cluster; one count a round is returned to
    the driver.  Lineage is cut in the shared checkpoint folder.

    All nodes of a large component ask for one label, and a node with very many
    links is asked by all of them: both joins have the labels, one row a node,
    on the right, and their left side is cut by the skew handling of adaptive
    execution wherever one key fills more than its share.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v"))
    edges = cut_lineage(edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct())
    labels = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component"))
    for _ in range(MAX_ROUNDS):
        near = edges.join(labels.select(F.col("node").alias("v"), "component"), "v").groupBy("u").agg(F.min("component").alias("near"))
        better = labels.join(near, labels.node == near.u, "left").select("node", F.least("component", F.coalesce("near", "component")).alias("next"), F.col("component").alias("was"))
        jump = better.select(F.col("node").alias("target"), F.col("next").alias("far"))
        better = better.join(jump, better.next == jump.target, "left").select("node", "was", F.least("next", F.coalesce("far", "next")).alias("component"))
        better = cut_lineage(better)
        changed = better.filter("was <> component").limit(1).count()
        labels = better.select("node", "component")
        if not changed:
            return labels
    raise RuntimeError(f"components have not settled after {MAX_ROUNDS} rounds")
