"""Check values of FIXTURES.md: its role views, run as written there, through the operators."""

import re
from pathlib import Path

import pytest

from flowgraph.operators.projection import build_edges, node_rows
from flowgraph.plans import templates
from flowgraph.plans.triage import status_counts, triage
from flowgraph.sources.jsonl import conform, empty_raw
from flowgraph.specs import RAW_TABLES

SF = "/root/testdata/sf0.01"
ROLES = {
    "sales_order_headers": "soh",
    "sales_order_items": "soi",
    "outbound_delivery_headers": "odh",
    "outbound_delivery_items": "odi",
    "billing_document_headers": "bdh",
    "billing_document_items": "bdi",
    "journal_entry_items_accounts_receivable": "je",
    "payments_accounts_receivable": "pay",
    "products": "prod",
    "product_descriptions": "pdesc",
}


@pytest.fixture(scope="module")
def raw(spark):
    for t in ("orders", "lineitem", "part", "customer", "events"):
        spark.read.parquet(f"{SF}/{t}.parquet").createOrReplaceTempView(t)
    text = (Path(__file__).resolve().parents[1] / "FIXTURES.md").read_text(encoding="utf-8")
    for block in re.findall(r"```sql\n(.*?)```", text, re.S):
        for statement in filter(str.strip, block.split(";")):
            spark.sql(statement)
    return {t: conform(spark.table(ROLES[t]), t) if t in ROLES else empty_raw(spark, t) for t in RAW_TABLES}


def test_templates(raw):
    assert templates.broken_flows(raw).count() == 1942
    linked = templates.billing_document_to_journal_entry(raw)
    assert linked.count() == 13500
    assert linked.where("journalEntryNodeId IS NOT NULL").count() == 4451
    assert templates.clearing_documents(raw).count() == 6208


def test_nodes_and_edges(raw):
    assert node_rows(raw, "Payment").count() == 3608
    assert node_rows(raw, "SalesOrderItem").count() == 45832
    assert node_rows(raw, "Product").where("raw_table <> 'products'").count() == 100
    assert node_rows(raw, "OutboundDelivery").where("raw_table = 'outbound_delivery_items'").count() == 9494
    assert build_edges(raw, ["fulfilled_by"]).count() == 27882
    assert build_edges(raw, ["billed_by"]).count() == 19021


def test_triage(spark, raw):
    counts = {r["outcome"]: r["n"] for r in status_counts(triage(spark.table("messages"))).collect()}
    assert counts == {
        "billing_document_to_journal_entry": 2500,
        "top_products_by_billing_docs": 2500,
        "broken_flows": 2500,
        "out_of_domain": 2500,
        "unsupported_query": 5000,
    }
