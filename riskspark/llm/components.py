"""Connected components of a link table, by alternating large-star and small-star steps.

Each step joins every node with the least node it knows; after a few rounds every node points at the least node of its
component. All steps are joins and map-side combined minima, so a hub's links spread over tasks (AQE splits the joins), and
each round is written to the shared folder: a lost executor costs the round, not the history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.session import write_through


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the least node that can be reached. No links, no rows."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = write_through(edges, "edges")
    while not _stars(edges):
        edges = write_through(_small_star(_large_star(edges)).distinct(), "edges")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(edges.select("v", "v").distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether each node has one edge down and nothing below its end."""
    several = edges.groupBy("u").count().where("count > 1").select("u").limit(1)
    chained = edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").select("u").limit(1)
    return several.union(chained).isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its least neighbour (itself included)."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("least"))
    larger = edges.select(F.col("v").alias("u"), F.col("u").alias("far"))
    return larger.join(least, "u").select(F.col("far").alias("u"), F.col("least").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and the node itself, are linked to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    moved = edges.join(least, "u").where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.union(least.select("u", F.col("least").alias("v")))
