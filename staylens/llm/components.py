"""Connected components of a link table, by alternating star contraction.

Each round lets every node hand its larger neighbours, then its smaller ones, to its
least neighbour (Kiveris et al., Connected Components in MapReduce and Beyond, 2014)
until nothing moves.  Neighbour lists are never gathered: the least neighbour is an
aggregate joined back to the links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.session import settle


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(
        edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    )


def large_star(edges: DataFrame) -> DataFrame:
    around = both_ways(edges)
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return (
        around.where("b > a").join(least, "a")
        .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    )


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a")
    return (
        moved.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        .unionByName(least.select("a", F.col("m").alias("b"))).distinct()
    )


def label_components(links: DataFrame) -> DataFrame:
    """node, root for every node of ``links`` (a, b: long); root is the least node."""
    edges = settle(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    mark = None
    while True:
        # The state is a star forest once a whole round leaves the set of links as it is.
        now = edges.agg(
            F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)"))
        ).first()
        if now == mark:
            break
        mark = now
        edges = settle(small_star(large_star(edges)))
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
