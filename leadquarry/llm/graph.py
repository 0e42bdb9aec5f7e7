"""Connected components as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadquarry.session import discard, spool


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node of its component.

    Each round maps every node to the smallest node of its neighbourhood and contracts the edges
    accordingly, which at least halves every path; the maps are composed on the way.  Smallest
    neighbours are combined before the shuffle, so a hub with very many edges costs no more than
    its edges.
    """
    edges = spool(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    total = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = spool(both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("node"), F.least("a", "m").alias("root")))
        if total is None:
            total = step
        else:
            nxt = step.select(F.col("node").alias("root"), F.col("root").alias("further"))
            longer = spool(total.join(nxt, "root", "left").select("node", F.coalesce("further", "root").alias("root")))
            discard(total)
            total = longer
        left = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        shorter = spool(edges.join(left, "a").join(right, "b").where("ra <> rb").select(
            F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        discard(edges)
        if step is not total:
            discard(step)
        edges = shorter
        if edges.isEmpty():
            discard(edges)
            return total
