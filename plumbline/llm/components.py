"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """Rows (``node``, ``component``) for every linked node but the smallest ones.

    ``links`` has two bigint columns ``a`` and ``b``; null ends, loops and
    repeated links are ignored. ``component`` is the smallest node reachable. A
    node without a row is the smallest of its component, or linked to nothing.

    Every node is hung on the smallest node it knows, first its larger, then its
    smaller neighbours, until nothing moves. Rounds grow with the logarithm of
    the longest path. A node with many links is one running minimum per task
    and a join that Spark can split. Where minima or edges can be broadcast, a round
    has three shuffles: the driver keeps a record of each of their tasks.
    """
    edges = materialize(
        links.where("a IS NOT NULL AND b IS NOT NULL AND a != b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    state = _state(edges)
    while True:
        edges = materialize(_small_star(_large_star(edges)))
        now = _state(edges)
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = now


def _state(edges: DataFrame):
    """The number of edges and a checksum: equal only if no edge has moved."""
    checksum = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), checksum).first())


def _large_star(edges: DataFrame) -> DataFrame:
    # Every edge points from the larger to the smaller node. The star of the smaller
    # end is hung on the least node it knows; as many rows as edges, some of them alike.
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return edges.join(least.withColumnRenamed("u", "v"), "v").select("u", F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    # Both ends of an edge are hung on the least neighbour of its larger one.
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    ends = edges.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return ends.where("u > v").distinct()
