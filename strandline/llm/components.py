"""Connected components of a table of links, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import staged


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node that it can reach) for every node of links(a long, b long); self links count as nodes.

    Each step is a groupBy with a least value and a join; the state is written to the shared folder after each round.
    """
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    while True:
        large = _star(edges, larger_only=True)
        small = staged(_star(large, larger_only=False))
        # stars only: each node is linked with one smaller node, which is linked with none
        centres = small.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b"))
        bad = centres.where("n > 1").select("a").unionAll(small.join(small.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a"))
        if bad.isEmpty():
            break
        edges = small
    nodes = small.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionAll(nodes.select(F.col("component").alias("node"), "component").distinct())


def _star(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Link each node's neighbours (the larger ones, or itself and the smaller ones) with its least neighbour."""
    if larger_only:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.join(least, "u")
    if larger_only:
        new = linked.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        new = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return new.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
