"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import materialise


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), u > v. Every node's (larger or smaller) neighbours are tied to its least neighbour, or to itself."""
    if large:
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).select("u", "m")
        least = materialise(least, "cc-least")
        out = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = materialise(edges.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") > F.col("v")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with a link; a component is named by its least node.

    Each round is written to the shared folder, and the rounds end when the edges stop changing, which takes a number
    in proportion to the logarithm of the longest path. Nothing but counts comes to the driver.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col("u") > F.col("v")).distinct()
    edges = materialise(edges, "cc-edges")
    mark = _mark(edges)
    while mark[0]:
        edges = materialise(_star(_star(edges, True), False), "cc-edges")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
