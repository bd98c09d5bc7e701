"""Pipeline over ``documents``: each stage works on all that the one before it kept, and its decisions take effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgraph.llm.common import importable, table
from flowgraph.llm.exact_dedup import exact_dedup
from flowgraph.llm.pii import redact, train
from flowgraph.llm.quality import quality, without_lines
from flowgraph.llm.simhash import one_of_each
from flowgraph.llm.tokens import pack_digest
from flowgraph.session import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that are frequent on their host; ``n_chars`` follows a changed text.

    Rows equal in id, text and source share a verdict.
    """
    touched = quality(docs).filter("NOT kept OR gone_lines IS NOT NULL").select("doc_id", "text_hash", "host", "kept", "gone_lines")
    touched = touched.toDF("_id", "_th", "_host", "_kept", "_gone").dropDuplicates(["_id", "_th", "_host"])
    same = (
        docs["doc_id"].eqNullSafe(F.col("_id"))
        & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("_th"))
        & (F.coalesce(docs["source"], F.lit("")) == F.col("_host"))
    )
    left = docs.join(touched, same, "left").filter("_kept IS NULL OR _kept")
    changed = F.col("_gone").isNotNull()
    new = {"text": F.when(changed, without_lines(docs["text"], F.col("_gone"))).otherwise(docs["text"])}
    out = left.select(*[new.get(c, docs[c]).alias(c) for c in docs.columns], changed.alias("_changed"))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("_changed"), length).otherwise(F.col("n_chars")))
    return out.drop("_changed")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup(docs, carry=True).filter("kept").select("_row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of at most 4 differing bits join (fingerprints of 4-word shingles) the one with the smallest id."""
    return one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; personal data in their texts gives way to its kind, and ``n_chars`` follows the text."""
    clean = redact(docs, train())
    changed = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return clean.withColumns(changed)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents."""
    return pack_digest(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("pii", personal_data),
    ("packing", packing),
]

#: SimHash, the field and the tokenizer can't be expressed in SQL; the tests hold the rows against a plain version.
ORACLE_SQL = None


@importable
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read by the next stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
