"""One key holds a third of the rows: results stay whole, and the plans reduce or split it."""

from pyspark.sql import functions as F

from flowgraph.operators import traversal
from flowgraph.operators.joins import left_join_many
from flowgraph.operators.projection import build_edges, node_rows
from flowgraph.plans import templates

N = 30000


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def hot_raw(spark, make_raw):
    raw = make_raw()
    key = "CASE WHEN id % 3 = 0 THEN 'HOT' ELSE concat('k', id % 5000) END"
    ids = spark.range(N)
    from flowgraph.sources.jsonl import conform

    raw["outbound_delivery_items"] = conform(
        ids.selectExpr(
            f"{key} AS delivery_document", "lpad(id, 6, '0') AS delivery_document_item",
            f"{key} AS reference_sd_document", "lpad(id, 6, '0') AS reference_sd_document_item",
        ),
        "outbound_delivery_items",
    )
    raw["sales_order_headers"] = conform(
        ids.selectExpr(f"{key} AS sales_order").distinct(), "sales_order_headers"
    )
    raw["billing_document_items"] = conform(
        ids.selectExpr(f"{key} AS reference_sd_document", f"{key} AS material", "concat('b', id) AS billing_document"),
        "billing_document_items",
    )
    return raw


def test_hot_keys_are_reduced_before_the_shuffle(spark, make_raw):
    raw = hot_raw(spark, make_raw)
    nodes = node_rows(raw, "OutboundDelivery")
    assert "partial_min" in plan_of(nodes)
    want = raw["outbound_delivery_items"].select("delivery_document").distinct().count()
    assert nodes.count() == want
    assert build_edges(raw, ["delivered_as"]).count() == want
    top = templates.top_products_by_billing_docs(raw, 1).first()
    assert tuple(top) == ("HOT", N // 3)
    # Distinct counting splits a product over its documents first.
    assert "hashpartitioning(product" in plan_of(templates.top_products_by_billing_docs(raw)).replace("material", "product")


def test_left_join_with_a_hot_optional_side(spark):
    left = spark.createDataFrame([("HOT", 1), ("k1", 2), ("none", 3), (None, 4)], "a string, n int")
    right = spark.range(N).selectExpr("CASE WHEN id % 3 = 0 THEN 'HOT' ELSE concat('k', id) END AS b", "id AS v")
    got = left_join_many(left, right, {"a": "b"})
    want = left.join(right, F.col("a") == F.col("b"), "left")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_hub_neighbors_are_cut_on_the_map_side(spark, make_graph):
    nodes, _ = make_graph([("hub", "POSTED_AS", "x")])
    edges = spark.range(N).selectExpr(
        "concat('e', lpad(id, 6, '0')) AS edge_id", "concat('e', lpad(id, 6, '0')) AS edge_key",
        "CASE WHEN id % 3 = 0 THEN 'hub' ELSE concat('n', id) END AS src_node_id",
        "concat('t', id) AS dst_node_id", "'POSTED_AS' AS edge_type", "'{}' AS evidence",
    )
    found = traversal.neighbor_edges(edges, traversal.id_frame(spark, ["hub"]), limit=200)
    assert "WindowGroupLimit" in plan_of(found)
    assert [r["edge_key"] for r in found.orderBy("edge_key").collect()] == [f"e{i:06}" for i in range(0, 600, 3)]
    many = traversal.neighbor_edges(edges, traversal.id_frame(spark, ["hub"]), limit=5000)
    assert many.count() == 5000 and many.agg(F.max("edge_key")).first()[0] == f"e{3 * 4999:06}"


def test_skewed_join_partitions_are_split(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        edges = spark.range(0, N, 1, 8).selectExpr(
            "concat('e', id) AS edge_id", "concat('e', id) AS edge_key", "concat('n', id) AS src_node_id",
            "CASE WHEN id % 3 = 0 THEN 'hub' ELSE concat('t', id) END AS dst_node_id",
            "'POSTED_AS' AS edge_type", "uuid() AS evidence",
        )
        seeds = spark.range(N).selectExpr("CASE WHEN id = 0 THEN 'hub' ELSE concat('t', id) END AS seed_id")
        found = traversal.incident_edges(edges, seeds, "in")
        found.collect()
        assert "skew=true" in plan_of(found)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
