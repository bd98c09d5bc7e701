"""Data operators of the presentation side: filters, rankings, captions, previews."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import format_cell, format_value
from ..session import materialise
from ..specs import EDGE_SPECS, NODE_SPECS
from .registry import codes_for_ids, non_granular
from .traversal import with_degrees

if TYPE_CHECKING:
    from ..sources.links import Links

# Score and the substrings of a lower-cased attribute name that earn it.
RELEVANCE = (
    (6, ("amount", "net", "gross", "total")),
    (5, ("currency",)),
    (5, ("date", "time")),
    (4, ("status",)),
    (3, ("qty", "quantity")),
    (3, ("customer", "soldto", "partner")),
    (2, ("company", "plant", "storage")),
    (2, ("document", "order", "delivery", "billing")),
)
NODE_ITEMS, EDGE_ITEMS = 8, 6
PREVIEW_ROWS = 200


def hide_granular(edges: DataFrame) -> DataFrame:
    """The edges shown while the fine-grained overlay is hidden; nodes are not touched."""
    return non_granular(edges)


def mapping_filter(
    nodes: DataFrame, edges: DataFrame, active_ids: Iterable[str], highlighted: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Keep the edges of the active types, the nodes at their ends, and highlighted nodes.

    An empty selection keeps everything.
    """
    active_ids = list(active_ids)
    if not active_ids:
        return nodes, edges
    kept = edges.where(F.col("edge_type").isin(codes_for_ids(active_ids)))
    ids = kept.select(F.expr("explode(array(src_node_id, dst_node_id)) AS node_id"))
    if highlighted is not None:
        ids = ids.unionByName(highlighted.select("node_id"))
    return nodes.join(ids.distinct(), "node_id", "left_semi"), kept


def relevance(low: Column) -> Column:
    """Sum of the scores whose substrings occur in the lower-cased attribute name."""
    total = F.lit(0)
    for score, words in RELEVANCE:
        total = total + F.when(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), score).otherwise(0)
    return total


def score_of(name: str) -> int:
    return sum(score for score, words in RELEVANCE if any(w in name.lower() for w in words))


def _known_scores() -> Column:
    """Scores of the attribute names the graph uses, so that they are looked up, not searched again per row."""
    specs = [s.attr_names for s in NODE_SPECS.values()] + [list(s.evidence) for s in EDGE_SPECS.values()]
    names = sorted({n for names in specs for n in names})
    return F.expr("map(" + ", ".join(f"'{n}', {score_of(n)}" for n in names) + ")")


def relevant_attrs(df: DataFrame, json_column: str, max_items: int | None) -> DataFrame:
    """Add ``items``: the most relevant attributes of a JSON column as ``array<struct<score, key, value>>``.

    Empty values are left out; attributes without a score are left out unless
    none has one.  Score descending, then name; ``max_items`` None keeps all.
    It stays within the row: no explode, no shuffle.
    """
    kind = "schema_of_variant(e.value)"
    parts = "CAST(e.value AS array<string>)"
    text = (
        f"CASE WHEN {kind} NOT LIKE 'ARRAY%' THEN CAST(e.value AS string)"
        f" WHEN size({parts}) <= 6 THEN concat('[', array_join({parts}, ', ', ''), ']')"
        f" ELSE concat('[', size({parts}), ' items]') END"
    )
    entries = (
        f"transform(map_entries(from_json({json_column}, 'map<string,variant>')),"
        f" e -> struct(e.key AS key, {text} AS value))"
    )
    shown = df.withColumn("_t", F.expr(entries))
    filled = F.filter("_t", lambda e: (e["key"] != "") & ~e["value"].isin("", "null", "undefined"))
    lowered = F.transform(filled, lambda e: F.struct(F.lower(e["key"]).alias("l"), e["key"].alias("key"), e["value"].alias("value")))
    known = _known_scores()
    scored = F.transform(
        lowered,
        lambda e: F.struct((-F.coalesce(F.try_element_at(known, e["key"]), relevance(e["l"]))).alias("o"), e.alias("e")),
    )
    ordered = shown.withColumn("_s", F.sort_array(scored))
    scoring = "if(get(_s, 0).o < 0, filter(_s, e -> e.o < 0), _s)"
    chosen = F.expr(scoring if max_items is None else f"slice({scoring}, 1, {max_items})")
    items = F.transform(
        chosen, lambda e: F.struct((-e["o"]).alias("score"), e["e"]["key"].alias("key"), e["e"]["value"].alias("value"))
    )
    return ordered.withColumn("items", items).drop("_t", "_s")


def attr_relevance(df: DataFrame, id_column: str, json_column: str, max_items: int | None) -> DataFrame:
    """``relevant_attrs`` as rows: id, rank from 1, score, key, value."""
    picked = relevant_attrs(df.select(id_column, json_column), json_column, max_items)
    # The outer form keeps Spark from filtering on the list first, which would build it twice.
    rows = picked.select(id_column, F.posexplode_outer("items").alias("pos", "i")).where("pos IS NOT NULL")
    return rows.select(id_column, (F.col("pos") + 1).alias("rank"), "i.score", "i.key", "i.value")


def node_cards(nodes: DataFrame, edges: DataFrame, links: Links | None = None) -> DataFrame:
    """Type, key, ``total (in x, out y)`` and attributes of each node; with kept ``links`` no edge is read."""
    counted = with_degrees(nodes, edges, links)
    connections = F.format_string("%d (in %d, out %d)", "total_degree", "in_degree", "out_degree")
    return counted.select("node_id", "node_type", "node_key", connections.alias("connections"), "attrs")


def edge_captions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``source label → target label`` of each edge; an id stands in for a missing label."""
    labels = nodes.select("node_id", "label")
    src = labels.withColumnsRenamed({"node_id": "src_node_id", "label": "src_label"})
    dst = labels.withColumnsRenamed({"node_id": "dst_node_id", "label": "dst_label"})
    caption = F.concat(
        F.coalesce("src_label", "src_node_id"), F.lit(" → "), F.coalesce("dst_label", "dst_node_id")
    )
    return (
        edges.join(src, "src_node_id", "left")
        .join(dst, "dst_node_id", "left")
        .select("edge_id", F.col("edge_type").alias("title"), caption.alias("caption"))
    )


def format_cells(df: DataFrame, tooltip: bool = False) -> DataFrame:
    """All columns as display text."""
    fmt = format_value if tooltip else format_cell
    return df.select(*[fmt(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def table_preview(df: DataFrame, order: list[str], max_rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows of a result as text, with its row count and whether more rows exist.

    The result is written once and read for both, so its source is evaluated once.
    """
    df = materialise(df, "preview")
    total = df.agg(F.count("*")).scalar()
    shown = format_cells(df.orderBy(*order).limit(max_rows))
    return shown.withColumn("row_count", total).withColumn("truncated", F.col("row_count") > max_rows)
