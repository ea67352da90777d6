"""Connected components of a table of links, by contraction; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.storage import cut, drop_cut


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a long, b long); component: the smallest node reached.

    In each round every node points to its smallest neighbour if that is smaller, chains of pointers
    are halved twice, and links between nodes that now stand for the same one go. A round leaves at
    most half of the nodes that still have links. No links give no rows.
    """
    edges = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = None
    while not edges.isEmpty():
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("up"))
        for _ in range(2):
            above = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
            parent = parent.join(above, "up").select("node", F.col("top").alias("up"))
        parent = cut(parent, "parents")
        old_labels, labels = labels, parent
        if old_labels is not None:
            moved = old_labels.join(parent.select(F.col("node").alias("up"), F.col("up").alias("top")), "up", "left")
            labels = cut(moved.select("node", F.coalesce("top", "up").alias("up")), "labels")
        left = edges.join(parent.select(F.col("node").alias("a"), F.col("up").alias("x")), "a").join(parent.select(F.col("node").alias("b"), F.col("up").alias("y")), "b")
        old, edges = edges, cut(left.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        drop_cut(old, old_labels, parent if labels is not parent else None)
    drop_cut(edges)
    if labels is None:
        return links.sparkSession.createDataFrame([], "node long, component long")
    return labels.select("node", F.col("up").alias("component"))
