"""Connected components of an edge list by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, sweep

#: Nodes with more neighbours than LEAST, and than leaves HOT such nodes, are hot.
LEAST, HOT = 1_000, 1 << 20


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root) for every node of the edges (u, v): root is the smallest node of its component.

    Both rounds send a node's neighbours to the smallest one; sums are combined before the shuffle. The rows of a hot node
    stay where they are: there are at most HOT such nodes by the choice of their degree, and these go to all tasks. Only two
    numbers a round reach the driver. rows: about how many edges there are.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def with_least(e: DataFrame, least: DataFrame, n: int) -> DataFrame:
        many = max(LEAST, 2 * n // HOT)
        hot = F.broadcast(least.where(F.col("degree") > many).drop("degree"))
        rest = e.join(F.broadcast(least.where(F.col("degree") > many).select("u")), "u", "left_anti").join(least.where(F.col("degree") <= many).drop("degree"), "u")
        return e.join(hot, "u").select(*rest.columns).unionByName(rest)

    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), rows)
    before = state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")).select("u", F.least("u", "m").alias("m"), "degree")
        e = with_least(both.where("v > u"), least, before[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
        near = with_least(e, least, before[0])
        e = near.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), before[0])
        now = state(e)
        if now == before:
            break
        before = now
        del both, least, near
        sweep(e.sparkSession)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
