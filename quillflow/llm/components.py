"""Connected components of an edge table, by alternating large-star and small-star steps.

Rounds grow with the logarithm of the longest path; after MOST_ROUNDS, far beyond any path of 64-bit
ids, the query fails rather than return components that are not whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Rounds after which something is wrong: they grow with the logarithm of the longest path.
MOST_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link every node's neighbours to the least of them and itself.

    Large: the larger neighbours, over edges in both directions. Small: the node and its smaller
    neighbours. The least neighbour is a plain minimum, joined back, so no node's neighbours meet
    in one place.
    """
    if large:
        edges = edges.union(edges.select("v", "u"))
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    linked = edges.join(least, "u")
    if large:
        return linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    rest = linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) of every node that has an edge. edges: u, v, of one type."""
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    now, seen = staged(now, "links"), None
    for _ in range(MOST_ROUNDS):
        now = staged(_star(_star(now, large=True), large=False), "links")
        check = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if check == seen:
            roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
        seen = check
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
