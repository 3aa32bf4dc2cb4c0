"""Connected components of a table of links, by contraction towards the smallest id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with a link; component is the smallest id reachable.

    Alternates "each larger neighbour links to my smallest" and "each smaller
    neighbour links to my smallest" until every node but the smallest of its
    component has one link, to that one. Rounds grow with the logarithm of the
    diameter. Every step is an aggregation and a join, so a node with very
    many links is never gathered in one place; each round is written, and so
    are its aggregates, so that the joins with them can be split where a node
    is hot.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges = written(edges, "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "links-least")
        large = edges.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large, "links-large")
        smallest = written(large.groupBy("u").agg(F.min("v").alias("m")), "links-least")
        small = large.join(smallest, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).filter("u <> v")
        edges = written(smallest.select("u", F.col("m").alias("v")).unionByName(small).distinct(), "links")
        roots = edges.select(F.col("u").alias("v")).distinct()
        if edges.join(roots, "v", "left_semi").isEmpty() and edges.groupBy("u").count().filter("count > 1").isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
