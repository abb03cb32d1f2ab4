"""Connected components by alternating large-star and small-star steps.

Every step joins stored tables, so adaptive execution can split the rows of a
node with many neighbours, and each round's edges are written to the shared
folder, so a lost executor costs one step.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.expr("sum(cast(xxhash64(u, v) as decimal(38,0)))"), F.lit(0))).first())


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for each end of an edge (u, v); the root is its component's least node.

    Each round moves some node to a smaller one, so the rounds end; their number
    is about the logarithm of a component's size.
    """
    both = lambda e: e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    edges = scratch.table(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges0")
    before = _state(edges)
    for k in count(1):
        least = scratch.table(both(edges).groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), f"least{k}")
        wide = both(edges).join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        wide = scratch.table(wide.distinct(), f"wide{k}")
        least = scratch.table(wide.groupBy("u").agg(F.min("v").alias("m")), f"below{k}")
        narrow = wide.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        fresh = scratch.table(narrow.union(least.select("u", F.col("m").alias("v"))).distinct(), f"edges{k}")
        scratch.drop(f"edges{k - 1}", f"least{k}", f"wide{k}", f"below{k}")
        edges, now = fresh, _state(fresh)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
