"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.operators.spread import discard, settle


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
        edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return least.select("hi", F.col("m").alias("lo")).unionByName(moved).distinct()


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` -> ``(node, root)`` for every node with a link; ``root`` is the smallest node of its component.

    Only minima and links move: a node with a million links is a combined minimum and a join that adaptive execution
    can split. Each round is written to the shared folder in place of the one before, so a lost executor repeats one round at most. Rounds end
    when the links no longer change, which takes about log(n) of them. Self links and NULL ends are ignored, repeated
    links count once, an empty table has no nodes.
    """
    edges = settle(
        links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links"
    )
    before = _signature(edges)
    while before[0]:
        last, edges = edges, settle(_small_star(_large_star(edges)), "links")
        discard(last)
        now = _signature(edges)
        if now == before:
            break
        before = now
    found = edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return found.unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
