"""Joins that stay balanced when one key holds a large part of a side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_join_many(left: DataFrame, right: DataFrame, on: dict[str, str]) -> DataFrame:
    """Left outer join where ``right`` may hold many rows per key (``on``: left -> right column).

    AQE can split a hot key of the optional side of an outer join only in an
    inner join.  So the matches are an inner join, which it splits on either
    side, and the rest is an anti join against the distinct keys, which are
    reduced on the map side first.  Column names of the sides must differ.
    """
    matched = left.join(right, [F.col(a) == F.col(b) for a, b in on.items()])
    keys = right.select(*[F.col(b).alias(f"_{b}") for b in on.values()]).distinct()
    unmatched = left.join(keys, [F.col(a) == F.col(f"_{b}") for a, b in on.items()], "left_anti")
    absent = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields]
    return matched.unionByName(unmatched.select("*", *absent))
