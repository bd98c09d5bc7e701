"""Small helpers that the operators share: tables, null rules, row keys."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: White space of the word rule, as the inside of a character class.
BLANK = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; only Spark's reader opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` and ``text`` (null: empty), whatever other columns there are."""
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z lower-cased and every other letter left alone.

    ``lower`` is right, and fast, for text of ASCII only; ``translate`` does the rest.
    """
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def importable(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """In local mode, Python workers find this package wherever the session was started.

    On a cluster the package is installed, or given by ``--py-files``.
    """

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        context = spark.sparkContext
        if context.master.startswith("local") and not context.master.startswith("local-cluster"):
            context.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
        return query(spark, sf_dir)

    return run
