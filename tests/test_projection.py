import json
import os

import pytest

from flowgraph.operators import projection
from flowgraph.operators.projection import build_edges, build_nodes, certain, merge_rows, nodes_of_type
from flowgraph.specs import EDGE_SPECS

from conftest import column


def node(df, key):
    return df.where(f"node_key = '{key}'").collect()


def test_missing_keys_make_no_node(make_raw):
    raw = make_raw(
        sales_order_headers=[{"sales_order": None}, {"sales_order": ""}, {"sales_order": "1"}],
        sales_order_items=[{"sales_order": "1", "sales_order_item": ""}, {"sales_order": "1", "sales_order_item": "10"}],
    )
    assert column(build_nodes(raw), "node_key") == ["SalesOrder:1", "SalesOrderItem:1|10"]


def _items(make_raw):
    rows = [{"sales_order": str(i), "sales_order_item": "10", "net_amount": str(i)} for i in range(40)]
    rows += [{"sales_order": str(i), "sales_order_item": "10", "net_amount": f"-{i}"} for i in range(0, 40, 4)]
    rows += [{"sales_order": "1|2", "sales_order_item": "3", "net_amount": None}, {"sales_order": "1", "sales_order_item": "2|3", "net_amount": "9"}]
    return make_raw(sales_order_items=[*rows, {"sales_order": "1", "sales_order_item": "10", "net_amount": "1"}])


@pytest.mark.parametrize("bits", [None, 32])
def test_only_rows_of_keys_that_may_recur_are_moved(make_raw, monkeypatch, bits):
    if bits:  # nearly all keys share a bit with one that recurs
        monkeypatch.setattr(projection, "MAP_BITS", bits)
    raw, spec = _items(make_raw), projection.NODE_SPECS["SalesOrderItem"]
    rows = projection.source_rows(raw, spec, spec.sources[0])
    again = {r["node_key"]: r["again"] for r in projection.recurring(rows, "node_key").collect()}
    recur = {f"SalesOrderItem:{i}|10" for i in [1, *range(0, 40, 4)]} | {"SalesOrderItem:1|2|3"}
    assert all(again[k] for k in recur) and len(again) == 41
    if not bits:
        assert {k for k, found in again.items() if found} == recur
    amounts = {r["node_key"]: json.loads(r["attrs"])["netAmount"] for r in nodes_of_type(raw, "SalesOrderItem").collect()}
    assert amounts == {f"SalesOrderItem:{i}|10": str(i) if i % 4 else f"-{i}" for i in range(40)} | {"SalesOrderItem:1|2|3": "9"}
    assert nodes_of_type(raw, "SalesOrderItem").count() == 41


def test_delivery_headers_win_over_items(make_raw):
    raw = make_raw(
        outbound_delivery_headers=[{"delivery_document": "A", "shipping_point": "S1"}, {"delivery_document": "C"}],
        outbound_delivery_items=[{"delivery_document": "A"}, {"delivery_document": "B"}, {"delivery_document": "B"}],
    )
    got = {r["node_key"]: r for r in nodes_of_type(raw, "OutboundDelivery").collect()}
    assert sorted(got) == [f"OutboundDelivery:{x}" for x in "ABC"]
    assert json.loads(got["OutboundDelivery:A"]["attrs"])["shippingPoint"] == "S1"
    assert got["OutboundDelivery:A"]["raw_table"] == "outbound_delivery_headers"
    assert json.loads(got["OutboundDelivery:B"]["attrs"]) == {"deliveryDocument": "B"}
    assert list(json.loads(got["OutboundDelivery:C"]["attrs"])) == [
        "deliveryDocument", "creationDate", "shippingPoint", "overallGoodsMovementStatus", "overallPickingStatus",
    ]


def test_product_labels_and_referenced_products(make_raw):
    raw = make_raw(
        products=[{"product": "P1", "product_type": "X"}, {"product": "P2"}, {"product": "P3"}],
        product_descriptions=[
            {"product": "P1", "language": "EN", "product_description": "shoe"},
            {"product": "P1", "language": "DE", "product_description": "Schuh"},
            {"product": "P1", "language": "EN", "product_description": "boot"},
            {"product": "P2", "language": "DE", "product_description": "Hut"},
            {"product": "M1", "language": "EN", "product_description": "found"},
        ],
        sales_order_items=[{"sales_order": "1", "sales_order_item": "1", "material": m} for m in ("P1", "M1", "", None)],
        billing_document_items=[{"billing_document": "9", "billing_document_item": "1", "material": "M2"}],
    )
    got = {r["node_key"]: r for r in nodes_of_type(raw, "Product").collect()}
    labels = {k.split(":")[1]: r["label"] for k, r in got.items()}
    assert labels == {"P1": "boot", "P2": "Product P2", "P3": "Product P3", "M1": "found", "M2": "Product M2"}
    assert json.loads(got["Product:P1"]["attrs"])["productType"] == "X"
    assert json.loads(got["Product:M1"]["attrs"]) == {"product": "M1"}


def test_payment_with_two_dates_is_one_node_the_earlier_wins(make_raw):
    entry = {"company_code": "C", "clearing_doc_fiscal_year": "2025", "clearing_accounting_document": "Z"}
    raw = make_raw(
        journal_entry_items_accounts_receivable=[{**entry, "clearing_date": "2025-02"}, {**entry, "clearing_accounting_document": ""}],
        payments_accounts_receivable=[{**entry, "clearing_date": "2025-01"}],
    )
    rows = nodes_of_type(raw, "Payment").collect()
    assert [r["node_key"] for r in rows] == ["Payment:C|2025|Z"]
    assert json.loads(rows[0]["attrs"])["clearingDate"] == "2025-01"
    assert rows[0]["label"] == "Payment Z"


def test_padded_items_meet_unpadded_ones(make_raw):
    raw = make_raw(
        sales_order_items=[{"sales_order": "1", "sales_order_item": "10"}],
        outbound_delivery_items=[
            {"delivery_document": "D", "delivery_document_item": "000010", "reference_sd_document": "1", "reference_sd_document_item": "000010"},
            {"delivery_document": "D", "delivery_document_item": "000020", "reference_sd_document": "1", "reference_sd_document_item": "000000"},
        ],
        billing_document_items=[
            {"billing_document": "9", "billing_document_item": "10", "reference_sd_document": "D", "reference_sd_document_item": "10"},
            {"billing_document": "9", "billing_document_item": "20", "reference_sd_document": "D", "reference_sd_document_item": "0000109"},
        ],
    )
    assert column(build_edges(raw, ["fulfilled_by"]), "edge_key") == ["FULFILLED_BY:SalesOrderItem:1|10->OutboundDeliveryItem:D|000010"]
    # '0000109' is cut to '000010' and so meets the same delivery item.
    assert column(build_edges(raw, ["billed_by"]), "edge_key") == [
        "BILLED_BY:OutboundDeliveryItem:D|000010->BillingDocumentItem:9|10",
        "BILLED_BY:OutboundDeliveryItem:D|000010->BillingDocumentItem:9|20",
    ]
    evidence = json.loads(build_edges(raw, ["fulfilled_by"]).first()["evidence"])
    assert evidence == {"salesOrder": "1", "salesOrderItem": "000010", "deliveryDocument": "D"}


def test_same_edge_with_two_evidences_is_one_edge(make_raw):
    item = {"delivery_document": "D", "delivery_document_item": "000010", "reference_sd_document": "1"}
    raw = make_raw(
        sales_order_items=[{"sales_order": "1", "sales_order_item": "10"}],
        outbound_delivery_items=[{**item, "reference_sd_document_item": i} for i in ("10", "000010", "010")],
    )
    rows = build_edges(raw, ["fulfilled_by"]).collect()
    assert len(rows) == 1
    assert json.loads(rows[0]["evidence"])["salesOrderItem"] == "000010"


def test_wildcards_in_order_ids_join_by_equality(make_raw):
    orders = ["A", "A_", "A%", "AB", "A|1"]
    raw = make_raw(
        sales_order_headers=[{"sales_order": o} for o in orders],
        sales_order_items=[{"sales_order": o, "sales_order_item": "10"} for o in orders],
    )
    got = column(build_edges(raw, ["has_item_order"]), "edge_key")
    assert got == sorted(f"HAS_ITEM:SalesOrder:{o}->SalesOrderItem:{o}|10" for o in orders)


def test_keys_stay_unique_when_ids_hold_the_separator(make_raw):
    raw = make_raw(
        sales_order_headers=[{"sales_order": "A"}, {"sales_order": "A|B"}],
        sales_order_items=[{"sales_order": "A|B", "sales_order_item": "C"}, {"sales_order": "A", "sales_order_item": "B|C"}],
        outbound_delivery_items=[
            {"delivery_document": "X|Y", "delivery_document_item": "Z", "reference_sd_document": "A"},
            {"delivery_document": "X", "delivery_document_item": "Y|Z", "reference_sd_document": "A"},
        ],
    )
    for table, key in ((build_nodes(raw), "node_key"), (build_edges(raw), "edge_key")):
        keys = column(table, key)
        assert len(keys) == len(set(keys))


def test_material_of_the_surviving_item_decides(make_raw):
    item = {"sales_order": "1", "sales_order_item": "10"}
    raw = make_raw(sales_order_items=[{**item, "material": "M2"}, {**item, "material": "M1"}])
    assert column(build_edges(raw, ["order_item_refers_to_product"]), "edge_key") == [
        "REFERS_TO_PRODUCT:SalesOrderItem:1|10->Product:M1"
    ]
    assert "Product:M2" in column(build_nodes(raw), "node_key")


def test_dangling_references_make_no_edge(make_raw):
    raw = make_raw(
        billing_document_headers=[{"billing_document": "9"}],
        journal_entry_items_accounts_receivable=[
            {"company_code": "C", "fiscal_year": "1", "accounting_document": "7", "accounting_document_item": "1", "reference_document": r}
            for r in ("9", "8")
        ],
    )
    # Both rows have one key; the surviving node keeps reference 8, the edge comes from the row with 9.
    assert column(build_edges(raw, ["posted_as"]), "edge_key") == ["POSTED_AS:BillingDocument:9->JournalEntryItemAR:C|1|7|1"]


def test_edges_from_stored_nodes_equal_edges_from_raw(spark, make_raw):
    from flowgraph.queries import RoleTables

    raw = RoleTables(spark, "/root/testdata/sf0.001")
    nodes = build_nodes(raw)
    a, b = build_edges(raw), build_edges(raw, nodes=nodes)
    assert a.count() == b.count() and a.exceptAll(b).count() == 0


def test_joins_are_left_out_where_the_source_defines_the_node():
    sure = {n: (certain(s, s.src), certain(s, s.dst)) for n, s in EDGE_SPECS.items()}
    assert sure == {
        "has_item_order": (False, True),
        "delivered_as": (False, True),
        "has_item_delivery": (True, True),
        "fulfilled_by": (False, True),
        "has_item_billing": (False, True),
        "billed_as": (False, False),
        "billed_by": (False, True),
        "posted_as": (False, True),
        "cleared_by": (True, True),
        "order_item_refers_to_product": (True, True),
        "billing_item_refers_to_product": (True, True),
    }
    readable = {n for n, s in EDGE_SPECS.items() if projection._readable(s)}
    assert {"delivered_as", "has_item_delivery", "has_item_billing", "billed_as"} <= readable
    assert not readable & {"fulfilled_by", "cleared_by"}


def test_merge_keeps_loaded_rows(spark):
    old = spark.createDataFrame([("1", "old"), ("2", "old")], "id string, label string")
    new = spark.createDataFrame([("2", "new"), ("3", "b"), ("3", "a")], "id string, label string")
    assert sorted(map(tuple, merge_rows(old, new, "id").collect())) == [("1", "old"), ("2", "old"), ("3", "a")]


def test_rebuild_gives_the_same_ids(make_raw):
    raw = make_raw(sales_order_headers=[{"sales_order": str(i)} for i in range(20)])
    assert column(build_nodes(raw), "node_id") == column(build_nodes(raw), "node_id")


@pytest.fixture(scope="module")
def snapshot(spark):
    """The order-to-cash sample in JSON-lines folders, if its folder is given in FLOWGRAPH_SNAPSHOT."""
    from flowgraph.sources.jsonl import read_raw

    folder = os.environ.get("FLOWGRAPH_SNAPSHOT")
    if not folder:
        pytest.skip("FLOWGRAPH_SNAPSHOT is not set")
    return read_raw(spark, folder)


def test_snapshot_counts(snapshot):
    nodes = {r["node_type"]: r["n"] for r in projection.type_counts(build_nodes(snapshot), "node_type").collect()}
    edges = {r["edge_type"]: r["n"] for r in projection.type_counts(build_edges(snapshot), "edge_type").collect()}
    assert nodes == {
        "SalesOrderItem": 167, "OutboundDelivery": 86, "OutboundDeliveryItem": 137, "BillingDocument": 63,
        "BillingDocumentItem": 91, "JournalEntryItemAR": 123, "Product": 69, "Payment": 76,
    }
    assert edges == {
        "HAS_ITEM": 137, "FULFILLED_BY": 137, "BILLED_BY": 91, "POSTED_AS": 43, "CLEARED_BY": 120, "REFERS_TO_PRODUCT": 258,
    }


def test_snapshot_templates(snapshot):
    from flowgraph.plans.templates import run_template

    top = run_template("top_products_by_billing_docs", snapshot).collect()
    assert tuple(top[0]) == ("S8907367042006", 16) and tuple(top[1]) == ("S8907367035664", 6)
    assert run_template("broken_flows", snapshot).count() == 0
    found = run_template("billing_document_to_journal_entry", snapshot, billing_document="91150187").collect()
    assert {r["accountingDocument"] for r in found} == {"9400635958"}
    assert found[0]["billingDocumentNodeId"] and found[0]["journalEntryNodeId"]
