"""JSON-lines folders -> raw tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import path_exists
from ..specs import RAW_TABLES, json_key, promoted_columns, raw_schema

PATTERN = "*.jsonl"
_BLANKS = " \t\r\n\f\x0b"


def read_lines(spark: SparkSession, folder: str, pattern: str = PATTERN) -> DataFrame:
    """The non-blank lines of all matching files directly in ``folder``, as ``payload``."""
    lines = spark.read.option("pathGlobFilter", pattern).text(folder)
    return lines.select(F.btrim("value", F.lit(_BLANKS)).alias("payload")).where(F.col("payload") != "")


def promote(lines: DataFrame, columns: Iterable[str], mode: str = "FAILFAST") -> DataFrame:
    """Add the promoted columns, all text, from one parse of ``payload``.

    Text values come out as they are. JSON numbers keep their value: one with
    a fraction is read again as a decimal (38 digits), so ``1.50`` comes out
    as ``1.5`` and no digit is rounded away; ``payload`` keeps the original.

    A line is one JSON value: it is parsed as the only item of an array, so
    text after the value, or a second value, makes the line malformed.
    ``FAILFAST`` stops there, ``PERMISSIVE`` keeps the line in
    ``_corrupt_record`` with NULL columns.
    """
    if mode.upper() not in ("FAILFAST", "PERMISSIVE"):
        raise ValueError(f"mode must be FAILFAST or PERMISSIVE, got {mode!r}")
    columns = list(columns)
    fields = T.StructType([T.StructField(json_key(c), T.StringType()) for c in columns])
    wrapped = F.concat(F.lit("["), F.col("payload"), F.lit("]"))
    parsed = F.from_json(wrapped, T.ArrayType(fields), {"mode": mode.upper()})
    rows = lines.withColumn("_items", parsed)
    bad = F.col("_items").isNull() | (F.size("_items") != 1)
    if mode.upper() == "FAILFAST":
        message = F.concat(F.lit("malformed line: "), F.col("payload"))
        one = F.when(bad, F.raise_error(message).cast(fields)).otherwise(F.get("_items", F.lit(0)))
    else:
        one = F.when(~bad, F.get("_items", F.lit(0)))
    fraction = F.col("payload").rlike(r":\s*-?[0-9]+(\.|[eE])")
    rows = rows.withColumns({"j": one, "_exact": F.when(fraction, F.try_parse_json("payload"))})
    picked = [_exact(f"j.`{json_key(c)}`", json_key(c)).alias(c) for c in columns]
    if mode.upper() == "PERMISSIVE":
        picked.append(F.when(bad, F.col("payload")).alias("_corrupt_record"))
    return rows.select(*lines.columns, *picked)


def _exact(column: str, key: str) -> Column:
    """A promoted value; if it reads like a number with a fraction, by the exact parse of the line."""
    value = F.col(column)
    exact = F.try_variant_get("_exact", f"$.{key}", "string")
    return F.when(value.rlike(r"^-?[0-9.]+([eE][+-]?[0-9]+)?$"), F.coalesce(exact, value)).otherwise(value)


def _has_files(spark: SparkSession, folder: str, pattern: str) -> bool:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(path)
    return found is not None and len(found) > 0


def empty_raw(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], raw_schema(table))


def read_raw_table(
    spark: SparkSession, dataset_dir: str, table: str, mode: str = "FAILFAST", pattern: str = PATTERN
) -> DataFrame | None:
    """One raw table with row ids from 0; None if the folder is absent or holds no matching file."""
    folder = f"{dataset_dir.rstrip('/')}/{table}"
    if not _has_files(spark, folder, pattern):
        return None
    rows = promote(read_lines(spark, folder, pattern), promoted_columns(table), mode)
    return rows.select(F.monotonically_increasing_id().alias("row_id"), *rows.columns)


def wanted_tables(spark: SparkSession, dataset_dir: str, only: Iterable[str] | None) -> set[str]:
    """The tables to load; an unknown name and an absent dataset folder are errors."""
    wanted = set(only) if only else set(RAW_TABLES)
    unknown = wanted - set(RAW_TABLES)
    if unknown:
        raise ValueError(f"unknown tables: {sorted(unknown)}")
    if not path_exists(spark, dataset_dir):
        raise FileNotFoundError(f"dataset folder not found: {dataset_dir}")
    return wanted


def read_raw(
    spark: SparkSession, dataset_dir: str, only: Iterable[str] | None = None, mode: str = "FAILFAST", pattern: str = PATTERN
) -> dict[str, DataFrame]:
    """All raw tables (or ``only`` some); tables without a folder are empty but typed."""
    wanted = wanted_tables(spark, dataset_dir, only)
    out = {}
    for table in RAW_TABLES:
        if table in wanted:
            rows = read_raw_table(spark, dataset_dir, table, mode, pattern)
            out[table] = empty_raw(spark, table) if rows is None else rows
    return out


def conform(df: DataFrame, table: str) -> DataFrame:
    """Give a frame that plays a raw table's role all of its promoted columns, missing ones NULL."""
    have = set(df.columns)
    return df.selectExpr(
        *[f"CAST({c if c in have else 'NULL'} AS STRING) AS {c}" for c in promoted_columns(table)]
    )
