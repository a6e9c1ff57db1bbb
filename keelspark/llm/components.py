"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is two grouped minima and two joins, so a centre with very many neighbours is pre-aggregated before the shuffle; each
round's edges go to the shared folder, which cuts the lineage.  Nothing but two numbers per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (long).  Returns node, root: the least node reachable, for every node that has an edge.  No edges: no rows."""
    now = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    mark = _mark(now)
    while mark[0]:
        # large star: every larger neighbour, and the node itself, hangs on the least neighbour
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: what a node hangs on hangs on the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        after = staged(small.where("u <> v").distinct(), "cc")
        discard(now)
        now, before = after, mark
        mark = _mark(now)
        if mark == before:
            break
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Tells two rounds apart: how many edges, and two order-free sums over them."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.hash("v", "u").cast("decimal(38,0)"))).first()
    return tuple(row)
