"""Exact top-n per group that holds when one group has a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SALTS = 256


def top_n_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group, numbered from 1 in ``rank``.

    Up to Spark's window-group-limit threshold the limit is applied on the map
    side already.  Above it the rows are first cut per group and salt, so no
    task sorts more of a group than a share plus ``n`` rows per salt.
    """
    threshold = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n > threshold:
        salted = df.withColumn("_salt", F.expr(f"pmod(xxhash64({', '.join(df.columns)}), {_SALTS})"))
        shares = Window.partitionBy(*group, "_salt").orderBy(*order)
        df = salted.withColumn("_share", F.row_number().over(shares)).where(F.col("_share") <= n)
        df = df.drop("_salt", "_share")
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col(rank) <= n)
