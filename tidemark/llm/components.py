"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.operators.ordered import durable


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return (
        both.filter("b > a").join(least, "a").filter("b <> low")
        .select(F.col("b").alias("a"), F.col("low").alias("b"))
    )


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("low"))
    hung = down.join(least, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return hung.unionByName(least.select("a", F.col("low").alias("b")))


def _written(links: DataFrame) -> tuple[DataFrame, dict]:
    """The links as a table, with the count and checksum that its writing has seen."""
    seen = Observation()
    marks = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("marks")
    table = durable(links.observe(seen, F.count(F.lit(1)).alias("links"), marks))
    return table, seen.get


def merged(placed: DataFrame, links: DataFrame) -> DataFrame:
    """``placed(node, component)`` after more links between nodes, placed or not.

    The links are drawn between the components they join, which is a far smaller graph.
    """
    ends = placed.select(F.col("node").alias("a"), F.col("component").alias("x"))
    links = links.join(ends, "a", "left").withColumn("x", F.coalesce("x", "a")).select("x", "b")
    ends = ends.toDF("b", "y")
    links = durable(
        links.join(ends, "b", "left").select(F.col("x").alias("a"), F.coalesce("y", "b").alias("b")).filter("a <> b").distinct()
    )
    if links.isEmpty():
        return placed
    joined = durable(components(links)).toDF("component", "least")
    moved = placed.join(joined, "component", "left").select("node", F.coalesce("least", "component").alias("component"))
    # Nodes that only the new links have stand for themselves among the joined components.
    fresh = joined.join(placed.select(F.col("node").alias("component")), "component", "left_anti")
    return moved.unionByName(fresh.select(F.col("component").alias("node"), F.col("least").alias("component")))


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``; the component is its least node.

    Each round is written to the shared folder. The links become a forest of stars in a
    number of rounds that grows with the logarithm of the longest path; no group of links
    ever meets in one place. Self links and repeated links change nothing.
    """
    links, now = _written(links.filter("a <> b").select("a", "b").distinct())
    seen = None
    while now["links"] and now != seen:
        seen = now
        links, now = _written(_small_star(_large_star(links)).distinct())
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
