"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Every round is a join-free pair of group-bys over the edges, so no hub's neighbours meet in one row
of a join; the lineage is cut each round by a checkpoint in the shared folder.

Defined results. Edges are undirected; self-loops and null ends are ignored; repeated edges count
once. A node's component is its least node. Nodes without an edge don't appear.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.session import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: link each node's (larger, or smaller and itself) neighbours to its least neighbour."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        linked = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return linked.where("u != v").distinct()


def connected_components(edges: DataFrame, source: str, target: str, max_rounds: int = 40) -> DataFrame:
    """(node, component)."""
    pairs = edges.select(F.col(source).alias("u"), F.col(target).alias("v")).where("u is not null and v is not null and u != v").distinct()
    pairs = cut_lineage(pairs)
    before = None
    for _ in range(max_rounds):
        pairs = cut_lineage(_star(_star(pairs, large=True), large=False))
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        before = tuple(state)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
