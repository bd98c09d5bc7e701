import json
import re

import pytest
from pyspark.sql import functions as F

from flowgraph.operators import display, integrity
from flowgraph.plans import templates, triage
from flowgraph.plans.named import run_named

from conftest import column


def test_broken_flows(make_raw):
    raw = make_raw(
        sales_order_headers=[{"sales_order": o} for o in ("1", "2", "3", "3", None, "")],
        outbound_delivery_items=[
            {"delivery_document": "D1", "reference_sd_document": "1"},
            {"delivery_document": "D2", "reference_sd_document": "2"},
            {"delivery_document": None, "reference_sd_document": "3"},
            {"delivery_document": "D9", "reference_sd_document": None},
            {"delivery_document": "D4", "reference_sd_document": ""},
        ],
        billing_document_items=[{"reference_sd_document": "D1"}, {"reference_sd_document": "D9"}, {"reference_sd_document": None}],
    )
    got = [tuple(r) for r in templates.broken_flows(raw).orderBy("salesOrder").collect()]
    # Headers are not de-duplicated, and the templates keep empty ids.
    assert got == [("", True, False), ("2", True, False), ("3", True, False), ("3", True, False)]
    assert templates.run_template("broken_flows", raw, limit=1).count() == 1


def test_top_products(make_raw):
    raw = make_raw(
        billing_document_items=[{"material": m, "billing_document": b} for m, b in
                                [("A", "1"), ("A", "1"), ("A", "2"), ("B", "1"), (None, "1"), ("C", "1"), ("C", "3"), ("C", None)]]
    )
    got = [tuple(r) for r in templates.run_template("top_products_by_billing_docs", raw).collect()]
    assert got == [("A", 2), ("C", 2), ("B", 1), (None, 1)]


def test_billing_to_journal(make_raw):
    key = {"company_code": "C", "fiscal_year": "2025", "accounting_document": "7"}
    raw = make_raw(
        billing_document_headers=[{**key, "billing_document": "9"}, {**key, "billing_document": "8"}],
        journal_entry_items_accounts_receivable=[
            {**key, "reference_document": "9", "accounting_document_item": "1"},
            {**key, "reference_document": "9", "accounting_document_item": "2"},
            {**key, "reference_document": "9", "accounting_document_item": ""},
            {**key, "reference_document": "8", "fiscal_year": "2024", "accounting_document_item": "1"},
        ],
    )
    from flowgraph.operators.projection import build_nodes

    plain = templates.billing_document_to_journal_entry(raw)
    looked_up = templates.billing_document_to_journal_entry(raw, nodes=build_nodes(raw))
    assert plain.exceptAll(looked_up).count() == 0 and plain.count() == looked_up.count() == 4
    rows = {b: [r for r in plain.collect() if r["billingDocument"] == b] for b in "89"}
    assert len(rows["9"]) == 3 and sum(r["journalEntryNodeId"] is None for r in rows["9"]) == 1
    assert rows["8"][0]["accountingDocument"] == "7" and rows["8"][0]["journalEntryNodeId"] is None
    assert rows["8"][0]["billingDocumentNodeId"] is not None
    one = templates.run_template("billing_document_to_journal_entry", raw, billing_document="8")
    assert column(one, "billingDocument") == ["8"]
    with pytest.raises(ValueError):
        templates.run_template("../secret", raw)


MESSAGES = [
    ("", False, None, None),
    ("disorder", True, None, None),
    ("x12345678", False, None, None),
    ("12345", False, None, None),
    ("is 123456 known?", True, None, None),
    ("1234567890", True, None, None),
    ("12345678901", False, None, None),
    ("é12345678", False, None, None),
    ("journal of 12345678 and 87654321", True, triage.JOURNAL, "12345678"),
    ("ACCOUNTING for 1234567", True, None, None),
    ("Highest INVOICE count per material", True, triage.TOP, None),
    ("highest billing", True, None, None),
    ("broken flows", False, None, None),
    ("incomplete order", True, triage.FLOWS, None),
    ("journal 12345678 highest billing product broken", True, triage.JOURNAL, "12345678"),
    ("  broken order \n", True, triage.FLOWS, None),
]


def test_triage_rules(spark):
    frame = spark.createDataFrame([(i, m[0]) for i, m in enumerate(MESSAGES)] + [(99, None)], "message_id int, text string")
    got = {r["message_id"]: r for r in triage.triage(frame).collect()}
    for i, (text, domain, template, document) in enumerate(MESSAGES):
        r = got[i]
        assert (r["in_domain"], r["template"], r["billing_document"]) == (domain, template, document), text
        expected = "out_of_domain" if not domain else None if template else "unsupported_query"
        assert r["rejection_reason"] == expected and r["rejected"] == (expected is not None)
        # The id patterns read as in Python, Unicode included.
        assert bool(re.search(r"\b\d{6,10}\b", text)) == bool(
            spark.range(1).select(F.lit(text).rlike(triage.DOCUMENT_ID)).first()[0]
        )
    assert got[99]["rejection_reason"] == "out_of_domain"
    assert got[8]["params"] == {"billing_document": "12345678"} and got[8]["limit"] == 10
    assert got[13]["params"] == {} and got[13]["limit"] == 50


def test_answers(spark, make_raw):
    key = {"company_code": "C", "fiscal_year": "2025"}
    raw = make_raw(
        sales_order_headers=[{"sales_order": "1"}],
        outbound_delivery_items=[{"delivery_document": "D", "reference_sd_document": "1"}],
        billing_document_items=[{"material": f"M{i}", "billing_document": str(j)} for i in range(7) for j in range(i + 1)],
        billing_document_headers=[
            {**key, "billing_document": "10000001", "accounting_document": "7"},
            {**key, "billing_document": "10000002", "accounting_document": ""},
        ],
        journal_entry_items_accounts_receivable=[
            {**key, "accounting_document": "7", "accounting_document_item": f"{i:02}", "reference_document": "10000001"} for i in range(15)
        ],
    )
    texts = {
        1: "journal for 10000001", 2: "journal for 10000002", 3: "journal for 10000003",
        4: "highest billing product", 5: "broken order", 6: "a story", 7: "order?",
    }
    triaged = triage.triage(spark.createDataFrame(list(texts.items()), "message_id int, text string"))
    got = {r["message_id"]: r for r in triage.answer(triaged, raw).collect()}
    assert got[1]["answer"] == "The journal entry number linked to billing document 10000001 is 7."
    assert got[1]["row_count"] == 10 and len(json.loads(got[1]["rows"])) == 10
    assert got[1]["columns"] == ["billingDocument", "accountingDocument", "billingDocumentNodeId", "journalEntryNodeId"]
    marks = got[1]["highlights"]
    first = json.loads(got[1]["rows"])[0]
    assert marks["focusNodeId"] == first["billingDocumentNodeId"]
    assert marks["highlightNodeIds"][:2] == [first["billingDocumentNodeId"], first["journalEntryNodeId"]]
    assert len(marks["highlightNodeIds"]) == 11 and marks["highlightEdgeIds"] == []
    assert got[2]["answer"] == "I found billing document 10000002, but no linked journal entry was returned."
    assert (got[3]["answer"], got[3]["row_count"], got[3]["columns"]) == (triage.NO_ROWS, 0, [])
    assert got[4]["answer"] == "Top products by number of billing documents:\n- M6: 7\n- M5: 6\n- M4: 5\n- M3: 4\n- M2: 3"
    assert got[4]["highlights"] is None and got[4]["row_count"] == 7
    assert got[5]["answer"] == "Found 1 sales orders with incomplete flows (sample shown in the table)."
    assert (got[6]["answer"], got[6]["rejection_reason"]) == (triage.OUT_OF_DOMAIN, "out_of_domain")
    assert (got[7]["answer"], got[7]["rejection_reason"]) == (triage.UNSUPPORTED, "unsupported_query")
    empty = {r["message_id"]: r for r in triage.answer(triaged, None).collect()}
    assert empty[1]["rejection_reason"] == "data_not_loaded" and empty[1]["answer"] == triage.NOT_LOADED
    assert empty[6]["rejection_reason"] == "out_of_domain"


def test_uuid_notations(spark):
    canonical = "caccffac-b24d-5a4c-8380-13dfbc68cc68"
    for text, want in (
        (canonical, canonical), (canonical.upper(), canonical), (canonical.replace("-", ""), canonical),
        ("{" + canonical + "}", canonical), ("urn:uuid:" + canonical, canonical), ("not an id", None), ("", None),
    ):
        assert spark.range(1).select(triage.as_uuid(F.lit(text))).first()[0] == want


def test_attribute_ranking(spark):
    rows = [
        (1, '{"netAmount":"5","zeta":"x","billingStatus":"C","currency":null,"plant":"","soldToParty":"7","list":[1,2,3]}'),
        (2, '{"b":"2","a":[1,2,3,4,5,6,7],"c":"[text","d":{"k":1},"e":true,"f":"null"}'),
        (3, "{}"),
    ]
    frame = spark.createDataFrame(rows, "id int, attrs string")
    got = {}
    for r in display.attr_relevance(frame, "id", "attrs", 4).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((r["rank"], r["score"], r["key"], r["value"]))
    assert got[1] == [(1, 6, "billingStatus", "C"), (2, 6, "netAmount", "5"), (3, 3, "soldToParty", "7")]
    assert got[2] == [(1, 0, "a", "[7 items]"), (2, 0, "b", "2"), (3, 0, "c", "[text"), (4, 0, "d", '{"k":1}')]
    assert 3 not in got
    for name in ("netAmount", "overallBillingStatus", "x", "creationDateTime", "clearingDate"):
        assert spark.range(1).select(display.relevance(F.lower(F.lit(name)))).first()[0] == display.score_of(name)


def test_filters_and_captions(make_graph):
    from flowgraph.operators.registry import ids_for_codes

    nodes, edges = make_graph([("a", "POSTED_AS", "b"), ("c", "HAS_ITEM", "d")], lone=["z"])
    shown, kept = display.mapping_filter(nodes, edges, ids_for_codes(["POSTED_AS"]), nodes.where("node_id = 'z'"))
    assert column(shown, "node_id") == ["a", "b", "z"] and column(kept, "edge_type") == ["POSTED_AS"]
    assert display.mapping_filter(nodes, edges, [])[0].count() == 5
    assert column(display.hide_granular(edges), "edge_type") == ["POSTED_AS"]
    captions = display.edge_captions(nodes.where("node_id <> 'b'"), edges).collect()
    assert {r["caption"] for r in captions} == {"label a → b", "label c → label d"}
    cards = {r["node_id"]: r["connections"] for r in display.node_cards(nodes, edges).collect()}
    assert cards["a"] == "1 (in 0, out 1)" and cards["z"] == "0 (in 0, out 0)"


def test_preview(spark):
    rows = spark.range(250).selectExpr("id", "CASE WHEN id > 0 THEN id END AS x")
    got = display.table_preview(rows, ["id"]).collect()
    assert len(got) == 200 and got[0]["x"] == "" and got[0]["row_count"] == 250 and got[0]["truncated"]
    assert not display.table_preview(rows, ["id"], 250).first()["truncated"]


def test_audits(make_graph, make_raw):
    nodes, edges = make_graph([("a", "POSTED_AS", "b"), ("b", "CLEARED_BY", "c")])
    kept = nodes.where("node_id <> 'c'")
    assert [(r["edge_key"], r["missing"]) for r in integrity.dangling_edges(kept, edges).collect()] == [("CLEARED_BY:b->c", "dst")]
    assert column(integrity.cascade_edges(edges, kept), "edge_key") == ["POSTED_AS:a->b"]
    twice = {r["constraint"]: r["n"] for r in integrity.duplicate_keys(nodes.unionAll(nodes.where("node_id = 'a'")), edges.unionAll(edges.limit(1))).collect()}
    assert twice == {"node_key": 2, "edge_key": 2, "src_type_dst": 2}
    nulls = integrity.not_null_audit(nodes.selectExpr("node_id", "node_key", "node_type", "nullif(label, 'label a') AS label", "attrs"), edges)
    assert {(r["table"], r["column"]): r["n_null"] for r in nulls.where("n_null > 0").collect()} == {("graph_nodes", "label"): 1}
    raw = make_raw(outbound_delivery_items=[{"delivery_document": "D", "reference_sd_document": s} for s in ("1", "1", "2")],
                   sales_order_headers=[{"sales_order": "1"}])
    lost = {(r["rule"], r["missing"]): r["n_references"] for r in integrity.dangling_references(raw).collect()}
    assert lost == {("delivered_as", "src"): 1}


def test_named_queries(spark, make_graph):
    nodes, edges = make_graph([("a", "POSTED_AS", "b"), ("a", "HAS_ITEM", "a")])
    tables = {"nodes": nodes, "edges": edges}
    run = lambda name, **params: [tuple(r) for r in run_named(spark, name, tables, params).collect()]
    assert run("node_id_by_key", node_key="T:a") == [("a",)]
    assert run("degrees", node_id="a") == [(1, 2)]
    assert run("nodes_by_ids", node_ids=["a", "x"])[0][0] == "a"
    assert run("node", node_id="' OR true --") == []
    assert len(run("edges_of_type", edge_type="POSTED_AS", limit=5)) == 1
    with pytest.raises(ValueError):
        run("drop", node_id="a")
