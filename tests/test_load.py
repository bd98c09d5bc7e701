import json

import pytest

from flowgraph.operators.integrity import payload_null_audit
from flowgraph.session import scratch_dir
from flowgraph.sources.jsonl import promote, read_lines, read_raw
from flowgraph.sources.tables import ensure_databases, graph_tables, load_raw, raw_tables, write_graph
from flowgraph.specs import RAW_TABLES


@pytest.fixture
def dataset(tmp_path):
    def put(table, records, name="part-1.jsonl", extra=""):
        folder = tmp_path / table
        folder.mkdir(exist_ok=True)
        (folder / name).write_text("\n".join(json.dumps(r) for r in records) + extra, encoding="utf-8")

    put("sales_order_headers", [{"salesOrder": "1", "totalNetAmount": "5.10", "x": {"h": 1}}, {"salesOrder": "2", "soldToParty": None}], extra="\n\n   \n\t\n")
    put("sales_order_headers", [{"salesOrder": "3", "overallDeliveryStatus": "", "totalNetAmount": 1.5}], "part-2.jsonl")
    put("sales_order_headers", [{"salesOrder": "99"}], "ignored.json")
    put("sales_order_items", [{"salesOrder": "1", "salesOrderItem": "10", "material": "M"}])
    (tmp_path / "plants").mkdir()
    return str(tmp_path)


def test_read_and_promote(spark, dataset):
    raw = read_raw(spark, dataset)
    assert list(raw) == list(RAW_TABLES)
    rows = {r["sales_order"]: r for r in raw["sales_order_headers"].collect()}
    assert sorted(rows) == ["1", "2", "3"]
    assert json.loads(rows["1"]["payload"])["x"] == {"h": 1}
    assert rows["1"]["total_net_amount"] == "5.10" and rows["3"]["total_net_amount"] == "1.5"
    assert rows["2"]["sold_to_party"] is None and rows["3"]["overall_delivery_status"] == ""
    assert len({r["row_id"] for r in rows.values()}) == 3
    assert raw["plants"].count() == 0 and raw["product_plants"].columns[:2] == ["row_id", "payload"]
    assert payload_null_audit(raw).agg({"n_null": "sum"}).first()[0] == 0
    with pytest.raises(ValueError):
        read_raw(spark, dataset, only=["nope"])


def test_promoted_values_of_all_json_types(spark):
    line = '{"a":true,"b":{"hours":1,"minutes":2},"c":null,"d":12,"e":"t\\u00e9","f":[1]}'
    frame = spark.createDataFrame([(line,)], "payload string")
    got = promote(frame, list("abcdefg")).first()
    assert [got[c] for c in "abcdefg"] == ["true", '{"hours":1,"minutes":2}', None, "12", "té", "[1]", None]


def test_malformed_lines(spark, tmp_path):
    folder = tmp_path / "plants"
    folder.mkdir()
    (folder / "a.jsonl").write_text('{"plant":"P1"}\n{"plant": oops\n')
    lines = read_lines(spark, str(folder))
    with pytest.raises(Exception):
        promote(lines, ["plant"]).collect()
    rows = promote(lines, ["plant"], mode="permissive").collect()
    assert sorted(r["plant"] or "" for r in rows) == ["", "P1"]
    assert [r["_corrupt_record"] for r in rows if r["_corrupt_record"]] == ['{"plant": oops']


def test_load_rebuild_and_append(spark, dataset):
    ensure_databases(spark, "raw_t", "graph_t")
    ensure_databases(spark, "raw_t", "graph_t")
    audit = {r["table"]: tuple(r)[1:] for r in load_raw(spark, dataset, raw_db="raw_t").collect()}
    assert audit["sales_order_headers"] == ("ok", 3, 3, 0) and audit["plants"] == ("skip", 0, 0, 0)
    load_raw(spark, dataset, raw_db="raw_t")
    assert spark.table("raw_t.sales_order_headers").count() == 3
    assert write_graph(spark, raw_tables(spark, "raw_t"), "graph_t") == {"nodes": 5, "edges": 2}
    ids = {r["node_id"] for r in graph_tables(spark, "graph_t")[0].collect()}

    again = load_raw(spark, dataset, only=["sales_order_headers"], truncate=False, raw_db="raw_t").collect()
    assert [tuple(r) for r in again] == [("sales_order_headers", "ok", 3, 6, 0)]
    rows = spark.table("raw_t.sales_order_headers")
    assert rows.select("row_id").distinct().count() == 6
    # The raw table doubles, the graph does not.
    assert write_graph(spark, raw_tables(spark, "raw_t"), "graph_t", truncate=False) == {"nodes": 0, "edges": 0}
    assert write_graph(spark, raw_tables(spark, "raw_t"), "graph_t") == {"nodes": 5, "edges": 2}
    assert {r["node_id"] for r in graph_tables(spark, "graph_t")[0].collect()} == ids


def test_existing_nodes_win_and_old_items_get_new_edges(spark, make_raw):
    first = make_raw(sales_order_items=[{"sales_order": "7", "sales_order_item": "10", "material": "OLD"}])
    later = make_raw(
        sales_order_headers=[{"sales_order": "7"}],
        sales_order_items=[{"sales_order": "7", "sales_order_item": "10", "material": "NEW"}],
    )
    assert write_graph(spark, first, "graph_u") == {"nodes": 2, "edges": 1}
    counts = write_graph(spark, later, "graph_u", truncate=False)
    nodes, edges = graph_tables(spark, "graph_u")
    assert counts == {"nodes": 2, "edges": 1}  # the order and product NEW; the order's item edge
    assert sorted(r["edge_key"] for r in edges.collect()) == [
        "HAS_ITEM:SalesOrder:7->SalesOrderItem:7|10",
        "REFERS_TO_PRODUCT:SalesOrderItem:7|10->Product:OLD",
    ]


def test_scratch_folder_is_the_configured_one(spark):
    assert scratch_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
