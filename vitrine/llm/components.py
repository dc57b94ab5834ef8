"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum and an equi-join on the node, so a node with
very many links is pre-aggregated before the shuffle and split by AQE in the
join. Each round is written to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import stash


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links every neighbour (larger than the node: large star; not larger:
    small star) to the smallest of the node and its neighbours."""
    near = _both(edges) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    near = near.join(least, "u")
    if large:
        return near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    return near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has a link; the component is its
    smallest node. ``edges`` has columns u, v; loops and repeats are ignored."""
    now = stash(edges.where("u <> v").select("u", "v").distinct(), "cc")
    last = None
    for _ in range(rounds):
        now = stash(_star(_star(now, True), False), "cc")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        last = mark
    raise RuntimeError(f"components did not settle in {rounds} rounds")
