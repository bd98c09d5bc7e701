"""Exact dedup by content sort.

Texts are put in order by range partitioning with sampled splitters and an external sort, so that equal texts are
neighbours; each run of equal texts is found by full comparison of neighbours, and one row of it stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import lower_ascii, partitions, table

#: Rows looked at to find texts that fill a range of their own. It steers the dealing only: results never depend on it.
SAMPLE_ROWS = 20_000
#: A sampled text is hot from so many hits on; at most so many texts are treated as hot.
HOT_HITS, HOT_TEXTS = 8, 1_000
#: Bytes of the text that lead its sort key; the digest of the whole text ends it.
KEY_PREFIX = 32


def _norm(df: DataFrame, text_col: str):
    return lower_ascii(F.coalesce(df[text_col], F.lit("")))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per row of ``df``: ``doc_id, keep_id, group_size, kept, text_sha256``; with ``carry`` also ``_row``, a
    struct of all columns of ``df``.

    Texts are equal when identical after lower-casing A-Z; null counts as the empty text, and empty texts are equal.
    Of equal texts the row with the largest ``doc_id`` stays (a null id is the smallest). Rows equal in id and text
    can't be told apart: one of them stays. An empty table gives an empty result; other columns are left alone.

    Sort keys are a prefix and a digest of the text, so sampled splitters stay small however long texts are, and a
    range is never filled by a common opening. A text that would fill a range is dealt over several by id ("salt");
    its few partial groups are merged afterwards.
    """
    n = partitions(df.sparkSession)
    names = [f"_c{i}" for i in range(len(df.columns))]  # their own names may clash with ours
    plain = df.toDF(*names) if carry else df
    at = dict(zip(df.columns, names, strict=True)) if carry else {c: c for c in df.columns}
    id_col, text_col = at[id_col], at[text_col]

    # Texts so common that one range would hold little else, by a sample of rows.
    total = plain.count()
    share = min(1.0, SAMPLE_ROWS / max(total, 1))
    sample = plain.sample(fraction=share, seed=7)
    hot = (
        sample.select(F.sha2(_norm(sample, text_col), 256).alias("_hot_sha"))
        .groupBy("_hot_sha")
        .count()
        .filter(F.col("count") >= HOT_HITS)
        .orderBy(F.desc("count"), "_hot_sha")
        .limit(HOT_TEXTS)
        .select("_hot_sha", (F.ceil(F.col("count") * (4.0 * n / max(1.0, share * total))).cast("int") + 1).alias("_pieces"))
    )
    # At most HOT_TEXTS rows, so the broadcast is bounded; written, so that both uses below see the same texts.
    hot = materialise(hot, "hot")
    piece = lambda doc_id: F.pmod(F.xxhash64(doc_id), F.col("_pieces"))
    salted = (
        plain.select(
            plain[id_col].cast("long").alias("_id"),
            _norm(plain, text_col).alias("_norm"),
            *([F.struct(*names).alias("_row")] if carry else []),
        )
        .withColumn("_sha", F.sha2("_norm", 256))
        .join(F.broadcast(hot), F.col("_sha") == F.col("_hot_sha"), "left")
        .withColumn("_salt", F.coalesce(piece(F.col("_id")), F.lit(-1)))
        .withColumn("_key", F.concat(F.substring("_norm", 1, KEY_PREFIX), F.lit("\x00"), F.col("_sha")))
    )
    if carry:  # the text travels once, in its row
        ranged = salted.drop("_norm").repartitionByRange("_key", "_salt")
        ranged = ranged.withColumn("_norm", lower_ascii(F.coalesce(F.col(f"_row.{text_col}"), F.lit(""))))
    else:
        ranged = salted.repartitionByRange("_key", "_salt")

    # Sorted by key and whole text; the window compares whole neighbours, and needs no further exchange.
    run = Window.partitionBy("_key", "_salt", "_norm").orderBy(F.desc_nulls_last("_id"))
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = ranged.select(
        "_id",
        "_sha",
        "_salt",
        F.max("_id").over(whole).alias("_max"),
        F.count(F.lit(1)).over(whole).alias("_size"),
        F.row_number().over(run).alias("_rank"),
        *(["_row"] if carry else []),
    )

    # Partial groups of hot texts meet again; at most HOT_TEXTS rows come out.
    hot_rows = salted.filter(F.col("_salt") >= 0).select("_id", "_sha", "_pieces")
    merged = (
        hot_rows.groupBy(F.col("_sha").alias("_merged_sha"))
        .agg(F.max("_id").alias("_all_max"), F.count(F.lit(1)).alias("_all_size"), F.max("_pieces").alias("_pieces"))
        .withColumn("_all_salt", piece(F.col("_all_max")))
        .drop("_pieces")
    )
    joined = placed.join(F.broadcast(merged), (F.col("_sha") == F.col("_merged_sha")) & (F.col("_salt") >= 0), "left")
    hot_row = F.col("_all_size").isNotNull()
    out = joined.select(
        F.col("_id").alias("doc_id"),
        F.when(hot_row, F.col("_all_max")).otherwise(F.col("_max")).alias("keep_id"),
        F.when(hot_row, F.col("_all_size")).otherwise(F.col("_size")).cast("long").alias("group_size"),
        ((F.col("_rank") == 1) & (~hot_row | (F.col("_salt") == F.col("_all_salt")))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
        *([F.struct(*[F.col(f"_row.{n}").alias(c) for c, n in at.items()]).alias("_row")] if carry else []),
    )
    return out


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


# A-Z only: DuckDB's translate, as in the operator.
OP1_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(t) AS text_sha256
FROM n
"""
