"""Connected components of a table of links, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def _large_star(links: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked with the smallest of the node and its neighbours."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).hint("rebalance")
    return both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked with the smallest of these."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).hint("rebalance")
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for each node of ``links`` (two long columns): the smallest node it can reach.

    Links in any direction, repeated, or of a node with itself are allowed; links with a null are none; no links give
    no rows. Each round is written to the shared folder, which cuts lineage and outlives executors. Rounds grow with
    the logarithm of the number of nodes; a node with very many links is combined on the map side, and its join can be
    split, as an exchange by itself stands between the aggregate and the join.
    """
    u, v = links.columns
    spark = links.sparkSession
    now = materialise(
        links.select(F.col(u).alias("u"), F.col(v).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct(),
        "links",
    )
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        step = _small_star(_large_star(now).filter("u <> v").distinct()).filter("u <> v").distinct()
        now = materialise(step, "links")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
