"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelspark.operators.keys import cut_lineage, large


def _hang(edges: DataFrame, small: bool, many: bool) -> DataFrame:
    """Every edge (u, v), u > v, moves to the smallest neighbour of u (small) or, seen from both ends, of v (large)."""
    e = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    j = e.join(large(low) if many else low, "u")
    if small:
        out = j.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    else:
        out = j.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, many: bool = False) -> DataFrame:
    """(node, root) for every node of the undirected `edges` (u, v): root is the smallest node of its component.

    Nodes may be numbers, texts or structs; with `many` of them no join of a round is broadcast.

    Large and small stars in turn: every round keeps the components and at least halves the depth of long chains
    in practice, so rounds grow with the logarithm of the longest path. It ends when a round changes nothing.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    before = None
    while True:
        e = cut_lineage(_hang(_hang(e, False, many), True, many))
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before:
            break
        before = now
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
