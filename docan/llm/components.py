"""Connected components of an edge list by alternating large-star and small-star steps.

Each step is one shuffle on a node; a node with very many neighbours is met by aggregation (its least
neighbour, with map-side combine) and a join that adaptive execution can split, never by collecting
its neighbours. The number of rounds is logarithmic in the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docan.session import checkpoint

MAX_ROUNDS = 60


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Connects each node's larger (or not larger) neighbours to its least neighbour."""
    near = _both(edges) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = near.join(least, "u")
    if large:
        return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, source: str = "u", target: str = "v") -> DataFrame:
    """(node, component) of every node of an edge; the component is its least node."""
    current = checkpoint(edges.select(F.col(source).alias("u"), F.col(target).alias("v")).filter("u <> v").distinct())
    for _ in range(MAX_ROUNDS):
        after = checkpoint(_star(_star(current, True), False))
        same = after.join(current, ["u", "v"], "left_anti").isEmpty() and current.join(after, ["u", "v"], "left_anti").isEmpty()
        current = after
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    leaves = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(roots).distinct()
