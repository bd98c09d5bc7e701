"""Complete results, lossless loading, lookups by list, and settings."""

import json
import time

import pytest
from conftest import column
from pyspark.sql import functions as F

from flowgraph import queries, session
from flowgraph.functions.values import strip_text
from flowgraph.operators import display, traversal
from flowgraph.operators.registry import CODES, edge_type_id, with_type_id
from flowgraph.plans import named, triage
from flowgraph.queries import stored_graph
from flowgraph.sources.jsonl import promote, read_raw
from flowgraph.sources.tables import load_raw
from flowgraph.specs import NODE_SPECS

SF = "/root/testdata/sf0.001"
D, B = "DELIVERED_AS", "BILLED_AS"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# --- complete results


def test_all_neighbours_of_a_hub(make_graph):
    nodes, edges = make_graph([("hub", D, f"n{i:05d}") for i in range(10_000)])
    assert traversal.neighbor_edges(edges, ["hub"]).count() == 10_000
    assert traversal.neighbor_edges(edges, nodes.where("node_id = 'hub'")).count() == 10_000
    assert traversal.neighbor_edges(edges, ["hub"], limit=5_000).count() == 5_000
    with pytest.raises(ValueError):
        traversal.neighbor_edges(edges, ["hub"], limit=5_001)


def test_reach_goes_on_to_the_end(make_graph):
    nodes, edges = make_graph([(f"n{i:02d}", D, f"n{i + 1:02d}") for i in range(12)] + [("x", B, "y")])
    seeds = nodes.where("node_id = 'n00'")
    found = {r["node_id"]: r["depth"] for r in traversal.reach(edges, seeds, None, CODES).collect()}
    assert found == {f"n{i:02d}": i for i in range(13)}
    assert traversal.full_subgraph(nodes, edges, ["n00"], None)[1].count() == 12
    with pytest.raises(ValueError):
        traversal.subgraph(nodes, edges, ["n00"], max_hops=7)


def test_one_text_for_a_value_whatever_stands_beside_it(spark):
    rows = [(1, '{"grossTotal": 12345678901234567890.10}'), (2, '{"grossTotal": 12345678901234567890.10, "zz": [1]}')]
    found = display.attr_relevance(spark.createDataFrame(rows, "id int, attrs string"), "id", "attrs", None)
    shown = {(r["id"], r["key"]): r["value"] for r in found.collect()}
    assert shown[1, "grossTotal"] == shown[2, "grossTotal"] == "12345678901234567890.1"


def test_total_beside_the_shown_rows(spark, make_raw):
    raw = make_raw(
        sales_order_headers=[{"sales_order": f"{i:03d}"} for i in range(70)],
        outbound_delivery_items=[{"reference_sd_document": f"{i:03d}", "delivery_document": f"d{i}"} for i in range(70)],
    )
    asked = spark.createDataFrame([(1, "broken flows of orders")], "message_id int, text string")
    found = triage.answer(triage.triage(asked), raw).first()
    assert (found["row_count"], found["total_count"]) == (50, 70) and "50" in found["answer"]


# --- loading


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "payload string")


@pytest.mark.parametrize("bad", ['{"k":1}{"k":2}', '{"k":1} trailing', '{"k":1},{"k":2}', '{"k":', "5"])
def test_a_line_is_one_json_value(spark, bad):
    with pytest.raises(Exception):
        promote(lines(spark, '{"k":"a"}', bad), ["k"]).collect()
    rows = promote(lines(spark, '{"k":"a"}', bad), ["k"], "PERMISSIVE").collect()
    assert [(r["k"], r["_corrupt_record"]) for r in rows] == [("a", None), (None, bad)]


def test_numbers_keep_their_digits(spark):
    line = '{"a":12345678901234567890.10,"b":1e2,"c":"1.50","d":-0.000000000000000001,"e":12345678901234567890123}'
    found = promote(lines(spark, line), list("abcde")).first()
    assert found["a"] == "12345678901234567890.1" and float(found["b"]) == 100 and found["c"] == "1.50"
    assert float(found["d"]) == -1e-18 and found["e"] == "12345678901234567890123"


def test_names_and_folders_are_checked(spark, tmp_path):
    with pytest.raises(ValueError):
        load_raw(spark, str(tmp_path), only=["plantz"])
    for absent in (lambda p: load_raw(spark, p), lambda p: read_raw(spark, p)):
        with pytest.raises(FileNotFoundError):
            absent(str(tmp_path / "nowhere"))
    (tmp_path / "plants").mkdir()
    (tmp_path / "plants" / "a.jsonl").write_text('{"plant":"1"}\n{"plant":"2"} x\n')
    with pytest.raises(Exception):
        load_raw(spark, str(tmp_path), only=["plants"], raw_db="strict_db")
    audit = load_raw(spark, str(tmp_path), only=["plants"], raw_db="lenient_db", mode="PERMISSIVE").first()
    assert (audit["status"], audit["inserted"], audit["rows_in_table"], audit["malformed"]) == ("ok", 1, 1, 1)
    assert column(spark.table("lenient_db.plants"), "plant") == ["1"]
    aside = lambda: [tuple(r) for r in spark.table("lenient_db.quarantine").collect()]
    assert aside() == [('{"plant":"2"} x', "plants")]
    load_raw(spark, str(tmp_path), only=["plants"], raw_db="lenient_db", mode="PERMISSIVE", truncate=False)
    assert len(aside()) == 2  # appended, as the good lines are
    load_raw(spark, str(tmp_path), only=["plants"], raw_db="lenient_db", mode="PERMISSIVE")
    assert len(aside()) == 1
    (tmp_path / "plants" / "a.jsonl").write_text('{"plant":"1"}\n')
    assert load_raw(spark, str(tmp_path), only=["plants"], raw_db="lenient_db", mode="PERMISSIVE").first()["malformed"] == 0
    assert aside() == []
    for db in ("strict_db", "lenient_db"):
        spark.sql(f"DROP DATABASE IF EXISTS {db} CASCADE")


# --- lookups


def test_a_list_of_ids_is_a_filter_of_the_scan(spark):
    nodes, edges = stored_graph(spark, SF)
    ids = [r["node_id"] for r in nodes.where("node_type = 'SalesOrder'").limit(3).collect()]
    for found in (
        traversal.nodes_by_ids(nodes, ids),
        named.run_named(spark, "nodes_by_ids", {"nodes": nodes}, {"node_ids": ids}),
    ):
        plan = plan_of(found)
        assert "In(node_id, [" in plan and "Exchange" not in plan
        assert column(found, "node_id") == sorted(ids)
    plan = plan_of(traversal.neighbor_edges(edges, ids))
    assert "Exchange" not in plan and "Or(In(src_node_id" in plan
    assert named.run_named(spark, "nodes_by_ids", {"nodes": nodes}, {"node_ids": []}).count() == 0
    assert "BroadcastHashJoin" in plan_of(traversal.nodes_by_ids(nodes, traversal.id_frame(spark, ids)))
    assert [r["pos"] for r in traversal.id_frame(spark, ["b", "a", "b"]).collect()] == [0, 1]
    assert traversal.id_frame(spark, []).count() == 0


def test_a_subgraph_reads_its_seeds_once(spark):
    nodes, edges = stored_graph(spark, SF)
    seeds = nodes.where("node_type = 'Payment'").orderBy("node_id").limit(5)
    shown, kept = traversal.subgraph(nodes, edges, seeds, 2)
    assert plan_of(shown).count("graph_nodes") <= 2 and "TakeOrdered" not in plan_of(kept)
    assert {c for c in shown.columns} >= {"in_degree", "out_degree", "total_degree"}


def test_ids_are_hashed_once(spark):
    from flowgraph.plans.templates import billing_document_to_journal_entry
    from flowgraph.sources.roles import RoleTables

    codes = spark.createDataFrame([(c,) for c in [*CODES, "OTHER"]], "edge_type string")
    assert {r["edge_type"]: r["type_id"] for r in with_type_id(codes).collect()} == {c: edge_type_id(c) for c in [*CODES, "OTHER"]}
    assert billing_document_to_journal_entry(RoleTables(spark, SF)).where("journalEntryNodeId IS NULL").count() > 0


# --- values, settings


def test_strip_takes_linear_time(spark):
    text = "a" + " " * 100_000 + "b" + " \t　" * 1_000
    frame = spark.createDataFrame([(" \n" + text,)], "t string").select(strip_text(F.col("t")).alias("t"))
    frame.collect()
    began = time.time()
    assert frame.first()["t"] == "a" + " " * 100_000 + "b"
    assert time.time() - began < 1


def test_folders_of_one_machine_are_refused_on_a_cluster(spark):
    class Context:
        master, applicationId = "spark://host:7077", "app"
        _jvm, _jsc = spark.sparkContext._jvm, spark.sparkContext._jsc

    class Session:
        sparkContext = Context()

        def __init__(self, folder):
            self.conf = {"spark.checkpoint.dir": folder}

    for folder in ("/tmp/checkpoints", "file:///tmp/checkpoints", None):
        with pytest.raises(ValueError):
            session.scratch_dir(Session(folder))


class OnCluster:
    """A session that says it belongs to a cluster; all else is the real one's."""

    def __init__(self, spark, folder, name):
        self.spark, self.conf = spark, {"spark.checkpoint.dir": folder}
        self.sparkContext = type("Context", (), {"master": "spark://host:7077", "applicationId": name, "__getattr__": lambda _, x: getattr(spark.sparkContext, x)})()

    def __getattr__(self, name):
        return getattr(self.spark, name)


def test_a_local_path_that_is_shared_serves_on_a_cluster(spark, tmp_path):
    for k, folder in enumerate((f"{tmp_path}/a", f"file://{tmp_path}/b")):
        (tmp_path / "ab"[k]).mkdir()
        assert session.scratch_dir(OnCluster(spark, f"{folder}/", f"shared-{k}")) == folder
        assert not [*(tmp_path / "ab"[k]).iterdir()]  # nothing is left of the asking


def test_a_local_path_where_rows_are_lost_is_refused_on_a_cluster(spark, tmp_path, monkeypatch):
    (tmp_path / "a_file").write_text("")
    with pytest.raises(ValueError):
        session.scratch_dir(OnCluster(spark, f"{tmp_path}/a_file", "no-folder"))
    monkeypatch.setattr(session, "_reads_back", lambda *_: False)
    with pytest.raises(ValueError):
        session.scratch_dir(OnCluster(spark, f"{tmp_path}", "lost"))


def test_cleanup_removes_intermediate_tables(spark, monkeypatch):
    monkeypatch.setattr(session, "_MADE", {})
    kept = session.materialise(spark.range(3), "t")
    folder = kept.inputFiles()[0].rsplit("/", 2)[0]
    assert session.path_exists(spark, folder)
    assert session.cleanup(spark) == 1 and not session.path_exists(spark, folder)


def test_a_stored_graph_whose_files_were_removed_is_written_again(spark, monkeypatch):
    for kept in ("_GRAPHS", "_LINKS"):
        monkeypatch.setattr(queries, kept, {})
    monkeypatch.setattr(session, "_MADE", {})
    ask = ("edge_counts", "khop_reach")  # from the graph alone, and by its kept links
    first = [sorted(queries.QUERIES[name](spark, SF).collect()) for name in ask]
    before = stored_graph(spark, SF)
    assert stored_graph(spark, SF) is before  # written once
    assert session.cleanup(spark)
    assert [sorted(queries.QUERIES[name](spark, SF).collect()) for name in ask] == first
    assert stored_graph(spark, SF) is not before


# Attributes of each node type.
ATTRIBUTES = {
    "SalesOrder": "salesOrder soldToParty creationDate totalNetAmount transactionCurrency overallDeliveryStatus overallBillingStatus",
    "SalesOrderItem": "salesOrder salesOrderItem material requestedQuantity requestedQuantityUnit netAmount transactionCurrency"
    " productionPlant storageLocation",
    "OutboundDelivery": "deliveryDocument creationDate shippingPoint overallGoodsMovementStatus overallPickingStatus",
    "Payment": "companyCode fiscalYear clearingAccountingDocument clearingDate",
    "Product": "product productType productGroup baseUnit division",
}


def test_attribute_names(spark):
    nodes, _ = stored_graph(spark, SF)
    for node_type, names in ATTRIBUTES.items():
        assert NODE_SPECS[node_type].attr_names == names.split()
        found = nodes.where((F.col("node_type") == node_type) & (F.col("raw_table") == NODE_SPECS[node_type].sources[0].table)).first()
        assert list(json.loads(found["attrs"])) == names.split()
