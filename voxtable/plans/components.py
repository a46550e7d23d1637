"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voxtable.plans.storage import drop_staged, sorted_side, staged


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).head())


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v of one orderable type) to (node, root): root is the smallest node reachable.

    Large-star and small-star rounds alternate until the edges form stars around the
    roots: about log n rounds. Every round is joins on the nodes and minima that are
    summed before they are shuffled; its edges are staged, so lost executors cost one
    round. Nodes without an edge are not in the result; loops are ignored.
    """
    state = staged(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    seen = _mark(state)
    while seen[0]:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("_m"))
        large = both.filter("v > u").join(sorted_side(low, seen[0]), "u").select(F.col("v").alias("u"), F.col("_m").alias("v")).filter("u <> v").distinct()
        large = staged(large, "large-star")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("_m"))
        joined = down.join(sorted_side(low, seen[0]), "u")
        small = joined.select(F.col("v").alias("u"), F.col("_m").alias("v")).filter("u <> v").unionByName(low.withColumnRenamed("_m", "v")).distinct()
        new = staged(small, "small-star")
        drop_staged(large)
        drop_staged(state)
        state, before = new, seen
        seen = _mark(state)
        if seen == before:
            break
    roots = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
