"""Connected components of a graph given as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); nodes of one component share their root.

    Each round sends every node to the least of itself and its neighbours and contracts the edges. An edge keeps its
    ends connected through the round, and with ids in random order (hashes) a constant share of the nodes goes, so
    the rounds are logarithmic. A round's tables are written; hubs are pre-aggregated before the shuffle.
    """
    edges = written(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    labels = None
    while edges.take(1):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = written(both.groupBy("a").agg(F.min("b").alias("least")).select(
            F.col("a").alias("node"), F.least("a", "least").alias("parent")), "parents")
        if labels is None:
            labels = parent.select("node", F.col("parent").alias("root"))
        else:
            moved = parent.select(F.col("node").alias("root"), F.col("parent").alias("next"))
            labels = written(labels.join(moved, "root", "left").select(
                "node", F.coalesce("next", "root").alias("root")), "labels")
        left = parent.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        right = parent.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        edges = written(edges.join(left, "a").join(right, "b").filter("pa <> pb").select(
            F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
