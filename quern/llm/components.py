"""Connected components of a graph of 64-bit nodes, as DataFrame joins.

Alternating large-star and small-star steps (published as "Connected Components
in MapReduce and Beyond"): each step relinks a node's neighbours to the smallest
of them, with a ``min`` per node that is pre-aggregated and joined back, so no
list of neighbours is ever held by a task.  Each round is checkpointed; the
number of rounds grows with the logarithm of a component's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _relink(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v): link v (and, small star, u) to the least neighbour of u."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # the key as an expression: the aggregate's partitioning isn't taken over, so both
    # sides of the join are shuffled for it and a hub's edges can be split at run time
    least = least.select(F.expr("u ^ 0L").alias("w"), "m")
    linked = both.join(least, F.col("u") == F.col("w"))
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the root is the least node of the component; nodes without an edge are left out."""
    edges = cut(edges.select("u", "v").where("u <> v").distinct())
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    seen = None
    while True:
        edges = cut(_relink(_relink(edges, True), False))
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
