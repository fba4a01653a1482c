"""Connected components on Spark: alternating large-star and small-star steps.

Each round replaces the edge list by one in which every node points nearer to the smallest node
it can reach; it ends when the list stays the same. Edges are written to the shared scratch
folder after each round, so lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Connect neighbours of each node to the smallest node of its neighbourhood.

    ``larger``: the larger neighbours of u move to min(N(u) + u); otherwise edges point from a
    node to its smaller neighbours, which move there together with u.
    """
    if larger:
        arcs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        arcs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = arcs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = arcs.join(low, "u")
    if larger:
        out = moved.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a != b").distinct()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b): root is the smallest node reached."""
    mark = [F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))]
    edges = materialise(edges.select("a", "b").where("a != b"), name)
    last = None
    while True:
        edges = materialise(_star(_star(edges, True), False), name)
        now = tuple(edges.agg(*mark).first())
        if now == last:
            break
        last = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
