"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.session import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Tie each node's neighbours to its smallest one.

    Large: the neighbours above the node. Small: those below it, and the node.
    The smallest neighbour is combined before the shuffle; a node with very
    many edges is a skewed join, which Spark splits.
    """
    both = edges.union(edges.select("b", "a")).toDF("u", "v") if large else edges.select("b", "a").toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("m", "u").alias("m"))
    tied = both.join(least, "u")
    if large:
        out = tied.where(F.col("v") > F.col("u")).select(F.col("v").alias("b"), F.col("m").alias("a"))
    else:
        out = tied.select(F.col("v").alias("b"), F.col("m").alias("a")).union(
            least.select(F.col("u").alias("b"), F.col("m").alias("a")))
    return out.where("a < b").select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge; the component is its smallest node.

    Ends when every node is tied to the smallest of its component, after a
    number of rounds that grows with the logarithm of the nodes. Each round is
    written to the shared folder.
    """
    now = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where(
        "a < b").distinct(), "edges")
    seen = None
    while True:
        now = materialize(_star(_star(now, True), False), "edges")
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
        now.select("a", "a").distinct().toDF("node", "component"))
