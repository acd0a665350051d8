"""Trees and lineages: closures, pruning, nearest ancestors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.session import cut_lineage

#: A tree deeper than this is taken for a cycle.
MAX_DEPTH = 64


def closure(tree: DataFrame, child: str, parent: str) -> DataFrame:
    """(node, ancestor, distance) of all nodes, each its own ancestor at distance 0.

    Paths are doubled in each round, so a tree of depth d takes log2(d) joins.
    A parent equal to the node, or null, marks a root.
    """
    step = tree.filter(F.col(parent).isNotNull() & (F.col(parent) != F.col(child))).select(F.col(child).alias("node"), F.col(parent).alias("ancestor"), F.lit(1).cast("bigint").alias("distance"))
    paths, reach = cut_lineage(step.distinct()), 1
    while reach <= MAX_DEPTH:
        far = paths.filter(F.col("distance") == reach)
        if far.isEmpty():
            break
        more = far.alias("a").join(paths.alias("b"), F.col("a.ancestor") == F.col("b.node")).select("a.node", "b.ancestor", (F.col("a.distance") + F.col("b.distance")).alias("distance"))
        paths, reach = cut_lineage(paths.unionByName(more).distinct()), reach * 2
    else:
        raise ValueError("the tree has a cycle")
    nodes = tree.select(F.col(child).alias("node")).unionByName(tree.filter(F.col(parent).isNotNull()).select(F.col(parent).alias("node"))).distinct()
    return nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).cast("bigint").alias("distance")).unionByName(paths)


def descendant_counts(tree: DataFrame, child: str, parent: str, counts: DataFrame, key: str, n: str) -> DataFrame:
    """(ancestor, n): counts of a lineage with all its descendants, each counted once."""
    pairs = closure(tree, child, parent).select("node", "ancestor").distinct()
    return pairs.join(counts.select(F.col(key).alias("node"), n), "node").groupBy("ancestor").agg(F.sum(n).alias(n))


def nearest_with(tree: DataFrame, child: str, parent: str, value: str) -> DataFrame:
    """(node, value) of the nearest ancestor that has one."""
    have = tree.filter(F.col(value).isNotNull()).select(F.col(child).alias("ancestor"), value)
    return closure(tree, child, parent).join(have, "ancestor").groupBy("node").agg(F.min_by(value, "distance").alias(value))


def prune(tree: DataFrame, child: str, parent: str, keep: DataFrame) -> DataFrame:
    """(node, parent): kept nodes under their nearest kept ancestor."""
    kept = keep.select(F.col(keep.columns[0]).alias("node")).distinct()
    up = closure(tree, child, parent).filter("distance > 0").join(kept.withColumnRenamed("node", "ancestor"), "ancestor").groupBy("node").agg(F.min_by("ancestor", "distance").alias("parent"))
    return kept.join(up, "node", "left")
