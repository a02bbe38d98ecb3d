"""Connected components by alternating large-star and small-star steps.

Each step is one aggregation and one join over the edges, so the work is spread
over the cluster and a vertex with very many neighbours only meets its minimum,
never its neighbour list.  Lineage is cut in the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.filter("v < u")
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = near.join(least, "u")
    out = linked.filter("v > u") if large else linked
    out = out.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) long, any direction, loops and repeats allowed.

    Returns (u, component) for every vertex of an edge between two different
    vertices, where component is the smallest vertex reachable.  No edges: no rows.
    """
    edges = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        edges = cut(_star(_star(edges, True), False))
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.groupBy("u").agg(F.min("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("u"), F.col("v").alias("component")).distinct()
    )
