"""Connected components by alternating large-star and small-star.

Edges are rows (u, v). Large-star links every larger neighbour of a node to
the smallest of its neighbourhood, small-star every smaller one and the node
itself; repeated in turn they end, after some log(n) rounds, in one star
around the smallest node of each component. A node's neighbourhood is only
ever reduced to its minimum (combined before the shuffle) and joined back,
so a node with very many neighbours is not gathered anywhere. Every round is
written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faresight.llm.common import materialize


def _state(edges: DataFrame) -> tuple[DataFrame, tuple]:
    done = materialize(edges, "cc_edges")
    n = done.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
    return done, tuple(n)


def _star(sides: DataFrame, large: bool) -> DataFrame:
    low = sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    linked = sides.join(low, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) edges -> (node, component), the component named by its
    smallest node; nodes without an edge don't appear. Loops, repeated and
    reversed edges are allowed, edges with a null end are ignored."""
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, seen = _state(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        after_large = _star(both, True)
        # large-star leaves u > v, as small-star needs it
        edges, now = _state(_star(after_large, False))
        if now == seen:
            break
        seen = now
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
