"""Connected components by alternating large and small stars, on written tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from severa.llm.common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of any orderable type -> (node, root), root the smallest node of node's component.

    Only nodes of edges come back. Links point from a node to a smaller one, its parent. Each round replaces every
    parent by its own smallest parent (large star) and then links a node's parents, roots too, to the smallest of them
    (small star), so that also roots are hooked and rounds grow with the logarithm of a chain's length; it ends when
    every node has one parent, which has none. Links never outnumber edges. Both sides of each join are written tables,
    so that a star's centre is a skewed join that Spark can split. Nothing is collected but whether a row is left. No
    edges: no rows.
    """
    parents = written(edges.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("parent")).distinct(), "edges")
    while True:
        least = written(_least(parents), "least")
        tops = least.select(F.col("node").alias("at"), "root")
        several = least.where("root <> most").select("node")
        deep = parents.join(tops, parents["parent"] == tops["at"], "left_semi").select("node")
        if several.isEmpty() and deep.isEmpty():
            break
        large = parents.join(tops, parents["parent"] == tops["at"], "left").select("node", F.coalesce("root", "parent").alias("parent"))
        large = written(large.distinct(), "large")
        tops = written(_least(large).select("node", "root"), "tops")
        hooked = large.join(tops, "node").where("parent <> root").select(F.col("parent").alias("node"), F.col("root").alias("parent"))
        parents = written(hooked.union(tops).distinct(), "small", (parents, least, large, tops))
    return least.select("node", "root").union(least.select("root", "root").distinct())


def _least(parents: DataFrame) -> DataFrame:
    """A node's smallest and largest parent."""
    return parents.groupBy("node").agg(F.min("parent").alias("root"), F.max("parent").alias("most"))
