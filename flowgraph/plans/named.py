"""Parameterised SQL over the raw and graph tables, by name.

Only registered texts are run; values are bound as parameters and tables as
frames, so nothing from a request becomes part of the text.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

NAMED_SQL: dict[str, str] = {
    "node": "SELECT node_id, node_key, node_type, label, attrs FROM {nodes} WHERE node_id = :node_id",
    "node_id_by_key": "SELECT node_id FROM {nodes} WHERE node_key = :node_key",
    "nodes_by_ids": (
        "SELECT node_id, node_key, node_type, label, attrs FROM {nodes} WHERE node_id IN (:node_ids)"
    ),
    "degrees": (
        "SELECT count_if(dst_node_id = :node_id) AS in_degree, count_if(src_node_id = :node_id) AS out_degree"
        " FROM {edges} WHERE dst_node_id = :node_id OR src_node_id = :node_id"
    ),
    "edges_of_type": (
        "SELECT edge_id, edge_key, src_node_id, dst_node_id, edge_type, evidence FROM {edges}"
        " WHERE edge_type = :edge_type ORDER BY edge_key LIMIT :limit"
    ),
    "deliveries_of_order": (
        "SELECT DISTINCT delivery_document FROM {outbound_delivery_items} WHERE reference_sd_document = :sales_order"
    ),
}


def run_named(
    spark: SparkSession, name: str, tables: Mapping[str, DataFrame], params: Mapping[str, object]
) -> DataFrame:
    """Run a registered text over ``tables`` with bound ``params``; a list is bound value by value, so that an IN
    reaches the scan."""
    if name not in NAMED_SQL:
        raise ValueError(f"unknown query: {name!r}")
    text, args = NAMED_SQL[name], {}
    for param, value in params.items():
        if isinstance(value, (list, tuple)):
            each = {f"{param}_{i}": v for i, v in enumerate(value or [None])}
            text = text.replace(f":{param})", ", ".join(f":{p}" for p in each) + ")")
            args |= each
        else:
            args[param] = value
    return spark.sql(text, args=args, **{t: df for t, df in tables.items() if f"{{{t}}}" in text})
