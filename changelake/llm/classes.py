"""Connected classes of a set of links, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from changelake.llm.common import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of its neighbourhood."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(stored(least, "star-least"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them. Every link has u > v."""
    least = stored(links.groupBy("u").agg(F.min("v").alias("m")), "star-least")
    moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _settled(links: DataFrame) -> bool:
    """Whether every larger end has one link and is nobody's smaller end."""
    up = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    down = links.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    nodes = up.unionByName(down).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up > 1 or up > 0 and down > 0").isEmpty()


def connected_classes(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label) for every node with a link; label is the smallest node of its class.

    Links with a null end and links of a node with itself are ignored; repeated links count once. Each round is written to the
    shared folder. The number of rounds grows with the logarithm of the longest chain, and no node's links are gathered in one row:
    only minima are taken, which combine before they are sent.
    """
    ends = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"`{a}` is not null and `{b}` is not null")
    current = stored(ends.where("u != v").distinct(), "star")

    while not _settled(current):
        current = stored(_small_star(stored(_large_star(current), "star-large")), "star")
    return current.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )
