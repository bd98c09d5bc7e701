"""Edge-type dimension: ids, selection by request, listing, overlay of fine-grained types."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import name_id, uuid5
from ..specs import EDGE_TYPES

EDGE_TYPE_SCHEMA = (
    "id string, code string, display_name string, description string,"
    " src_node_type string, dst_node_type string, is_granular boolean, `group` string"
)


def edge_type_id(code: str) -> str:
    return name_id(code)


def edge_type_dim(spark: SparkSession) -> DataFrame:
    """The edge types, one row each."""
    return spark.createDataFrame([(edge_type_id(t[0]), *t) for t in EDGE_TYPES], EDGE_TYPE_SCHEMA)


CODES = [t[0] for t in EDGE_TYPES]
GRANULAR_CODES = [t[0] for t in EDGE_TYPES if t[5]]


def codes_for_ids(ids: Iterable[str]) -> list[str]:
    """Codes of the known ids, in the order given; unknown ids are left out."""
    by_id = {edge_type_id(c): c for c in CODES}
    return [by_id[str(i)] for i in ids if str(i) in by_id]


def ids_for_codes(codes: Iterable[str]) -> list[str]:
    return [edge_type_id(c) for c in codes if c in CODES]


def resolve_codes(edge_type_ids: Iterable[str] | None = None, include_granular: bool = True) -> list[str]:
    """The codes a request selects.

    No ids, or an empty list, select all registered codes; ids that are all
    unknown select nothing.  Codes outside the registry are never selected.
    """
    codes = codes_for_ids(edge_type_ids) if edge_type_ids else CODES
    return [c for c in codes if include_granular or c not in GRANULAR_CODES]


def non_granular(edges: DataFrame) -> DataFrame:
    """Edges without the fine-grained types; unknown codes count as coarse."""
    return edges.where(~F.col("edge_type").isin(GRANULAR_CODES))


def with_type_id(edges: DataFrame) -> DataFrame:
    """Add ``type_id``: the registered id, by a map of literals; any other code gets its name-based id."""
    known = "map(" + ", ".join(f"'{c}', '{edge_type_id(c)}'" for c in CODES) + ")"
    return edges.withColumn("type_id", F.coalesce(F.expr(f"{known}[edge_type]"), uuid5("edge_type")))


def edge_types_present(edges: DataFrame) -> DataFrame:
    """The distinct edge types of a graph, in byte order."""
    return edges.where("edge_type IS NOT NULL AND edge_type <> ''").select("edge_type").distinct().orderBy("edge_type")


def edge_type_listing(spark: SparkSession, edges: DataFrame | None = None) -> DataFrame:
    """Edge types present in the graph with their description; without a graph, the registered ones."""
    dim = edge_type_dim(spark)
    if edges is None:
        codes = dim.select("code")
    else:
        codes = edge_types_present(edges).withColumnRenamed("edge_type", "code")
    known = codes.join(dim.withColumnRenamed("id", "known_id"), "code", "left")
    label = "CASE WHEN known_id IS NULL THEN code ELSE concat(code, ' — ', display_name) END"
    return known.select(
        uuid5("code").alias("id"),
        "code",
        F.expr(label).alias("displayName"),
        F.expr("coalesce(description, concat('Relationship type ', code))").alias("description"),
        F.col("src_node_type").alias("srcNodeType"),
        F.col("dst_node_type").alias("dstNodeType"),
        F.coalesce("is_granular", F.lit(False)).alias("isGranular"),
        F.coalesce("group", F.lit("other")).alias("group"),
    ).orderBy("code")


def relationship_options(listing: DataFrame) -> DataFrame:
    """Choices of the relationship filter: all of them first, then by display name."""
    everything = listing.sparkSession.createDataFrame(
        [(0, "ALL", "All relationships")], "rank int, id string, label string"
    )
    types = listing.selectExpr("1 AS rank", "id", "displayName AS label")
    return everything.unionByName(types).orderBy("rank", "label")
