"""Every operator as a runnable query over the star tables in their document roles.

Build queries start from the raw roles.  Graph queries read the stored
projection, which is written once per session and folder, as it would be in
production.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.ids import name_id, uuid5
from .functions.values import present
from .operators import display, integrity, projection, registry, traversal
from .operators.projection import build_edges, build_nodes, nodes_of_type, source_rows, union_all
from .plans import named, templates, triage
from .session import discard, materialise, scratch_path, still_there
from .sources.deletion import delete_nodes
from .sources.incremental import extend_graph
from .sources.jsonl import empty_raw, promote, read_raw
from .sources.links import Links, keep_links, link_tables
from .sources.roles import ROLE_SQL, RoleTables, StarTables, messages
from .sources.tables import LOOKUP, ensure_databases, graph_tables, in_lookup_order, load_raw, store_graph, write_graph, write_raw
from .specs import NODE_SPECS, json_key

Query = Callable[[SparkSession, str], DataFrame]

_GRAPHS: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}
_LINKS: dict[tuple[str, str], Links] = {}


def stored_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The projection of a folder, written to the shared folder when first needed.

    It is kept for the application, so tables must not change while it runs;
    if its files were removed meanwhile, it is written again.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _GRAPHS or not all(map(still_there, _GRAPHS[key])):
        raw = RoleTables(spark, sf_dir)
        nodes = materialise(
            in_lookup_order(build_nodes(raw), "graph_nodes"), "graph_nodes", "node_type", LOOKUP["graph_nodes"]
        )
        edges = materialise(
            in_lookup_order(build_edges(raw, nodes=nodes), "graph_edges"), "graph_edges", "edge_type", LOOKUP["graph_edges"]
        )
        _GRAPHS[key] = (nodes, edges)
    return _GRAPHS[key]


def stored_links(spark: SparkSession, sf_dir: str) -> Links:
    """The degrees and the adjacency kept beside ``stored_graph``, in a database of their own."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LINKS or not all(map(still_there, (_LINKS[key].degrees, _LINKS[key].adjacency))):
        db = _own_database(spark, "links")
        keep_links(stored_graph(spark, sf_dir)[1], db, truncate=True)
        _LINKS[key] = link_tables(spark, db)
    return _LINKS[key]


QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --------------------------------------------------------------------------- templates and checks


@query
def broken_flows(spark, sf):
    return templates.broken_flows(RoleTables(spark, sf))


@query
def broken_flows_report(spark, sf):
    return templates.run_template("broken_flows", RoleTables(spark, sf))


@query
def top_products_by_billing_docs(spark, sf):
    return templates.run_template("top_products_by_billing_docs", RoleTables(spark, sf))


@query
def products_by_billing_docs(spark, sf):
    return templates.top_products_by_billing_docs(RoleTables(spark, sf))


@query
def billing_to_journal(spark, sf):
    return templates.billing_document_to_journal_entry(RoleTables(spark, sf))


def largest_document(raw: RoleTables) -> str:
    """The billing document with the highest net amount that has a journal entry of its fiscal year."""
    amounts = raw["billing_document_headers"].join(
        raw["journal_entry_items_accounts_receivable"].select(
            F.col("reference_document").alias("billing_document"), "fiscal_year"
        ),
        ["billing_document", "fiscal_year"],
        "left_semi",
    )
    amount = F.col("total_net_amount").cast("decimal(18,2)")
    return amounts.orderBy(amount.desc(), "billing_document").select("billing_document").first()[0]


@query
def billing_to_journal_one(spark, sf):
    raw = RoleTables(spark, sf)
    return templates.run_template("billing_document_to_journal_entry", raw, billing_document=largest_document(raw))


@query
def row_counts(spark, sf):
    return templates.row_counts(RoleTables(spark, sf))


@query
def deliveries_per_order(spark, sf):
    return templates.deliveries_per_order(RoleTables(spark, sf))


@query
def billing_journal_sanity(spark, sf):
    return templates.billing_journal_sanity(RoleTables(spark, sf))


@query
def referenced_materials(spark, sf):
    return templates.referenced_materials(RoleTables(spark, sf))


@query
def clearing_documents(spark, sf):
    return templates.clearing_documents(RoleTables(spark, sf))


@query
def filter_present(spark, sf):
    je = RoleTables(spark, sf)["journal_entry_items_accounts_receivable"]
    keys = ["accounting_document", "accounting_document_item", "clearing_accounting_document"]
    return je.where(present(*keys)).select(*keys)


# --------------------------------------------------------------------------- graph build

NODE_QUERY_NAMES = {
    "nodes_sales_order": "SalesOrder",
    "nodes_sales_order_item": "SalesOrderItem",
    "nodes_delivery": "OutboundDelivery",
    "nodes_delivery_item": "OutboundDeliveryItem",
    "nodes_billing": "BillingDocument",
    "nodes_billing_item": "BillingDocumentItem",
    "nodes_journal": "JournalEntryItemAR",
    "nodes_product": "Product",
    "nodes_payment": "Payment",
}

EDGE_QUERY_NAMES = {
    "edge_has_item_order": ["has_item_order"],
    "edge_delivered_as": ["delivered_as"],
    "edge_has_item_delivery": ["has_item_delivery"],
    "edge_fulfilled_by": ["fulfilled_by"],
    "edge_has_item_billing": ["has_item_billing"],
    "edge_billed_as": ["billed_as"],
    "edge_billed_by": ["billed_by"],
    "edge_posted_as": ["posted_as"],
    "edge_cleared_by": ["cleared_by"],
    "edge_refers_to_product": ["order_item_refers_to_product", "billing_item_refers_to_product"],
}

for _name, _type in NODE_QUERY_NAMES.items():
    QUERIES[_name] = lambda spark, sf, t=_type: nodes_of_type(RoleTables(spark, sf), t)
for _name, _rules in EDGE_QUERY_NAMES.items():
    QUERIES[_name] = lambda spark, sf, r=_rules: build_edges(RoleTables(spark, sf), r)


@query
def graph_nodes(spark, sf):
    return build_nodes(RoleTables(spark, sf))


@query
def graph_edges(spark, sf):
    return build_edges(RoleTables(spark, sf))


@query
def node_counts(spark, sf):
    return projection.type_counts(build_nodes(RoleTables(spark, sf)), "node_type")


@query
def edge_counts(spark, sf):
    return projection.type_counts(stored_graph(spark, sf)[1], "edge_type")


@query
def product_label_fallback(spark, sf):
    raw = RoleTables(spark, sf)
    return projection.product_labels(projection.node_rows(raw, "Product", ["product"]), raw).select("product", "label")


@query
def node_dedupe(spark, sf):
    rows = projection.node_rows(RoleTables(spark, sf), "OutboundDelivery")
    return rows.select("node_key", "source_rank", "raw_table", "creationDate", "overallGoodsMovementStatus")


@query
def uuid5_ids(spark, sf):
    orders = StarTables(spark, sf)["orders"]
    keys = orders.select(F.expr("concat('SalesOrder:', o_orderkey, ' ', o_orderpriority, ' é') AS name"))
    return keys.select("name", uuid5("name").alias("id"))


# --------------------------------------------------------------------------- load, append, merge


@query
def promote_json(spark, sf):
    events = StarTables(spark, sf)["events"].select("event_id", F.col("props").alias("payload"))
    return promote(events, ["k"]).select("event_id", "k")


#: Files of ``_json_lines``, and their most lines: one is read by one task, as gzip can't be entered midway.
JSON_FILES, JSON_FILE_LINES = "*.json.gz", 1_000_000


def _json_lines(raw: RoleTables) -> str:
    """All filled roles as folders of JSON lines, compressed; the folder's path."""
    folder = scratch_path(raw.star.spark, "jsonl")
    for table in ROLE_SQL:
        rows = raw[table].select(*[F.col(c).alias(json_key(c)) for c in raw[table].columns])
        writer = rows.write.option("maxRecordsPerFile", JSON_FILE_LINES)
        writer.json(f"{folder}/{table}", compression="gzip", ignoreNullFields=False)
    return folder


def _own_database(spark: SparkSession, kind: str) -> str:
    """A database of its own in the scratch folder; the caller drops it."""
    name = f"{kind}_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE `{name}` LOCATION '{scratch_path(spark, name)}'")
    return name


@query
def load_audit(spark, sf):
    """Write all filled roles as JSON lines, load the folders, and load part of them again in append mode."""
    folder = _json_lines(RoleTables(spark, sf))
    db = _own_database(spark, "raw")
    first = load_raw(spark, folder, raw_db=db, pattern=JSON_FILES)
    again = load_raw(spark, folder, ["products"], truncate=False, raw_db=db, pattern=JSON_FILES)
    audit = (
        first.withColumn("load", F.lit("truncate"))
        .unionByName(again.withColumn("load", F.lit("append")))
        .select("load", "table", "status", "inserted", "rows_in_table", "malformed")
    )
    spark.sql(f"DROP DATABASE `{db}` CASCADE")  # the audit is a table of its own
    discard(spark, folder)
    return audit


@query
def load_quarantine(spark, sf):
    """Product lines with every tenth cut short: what a permissive load keeps, and the lines it puts aside."""
    folder, table = scratch_path(spark, "jsonl"), "products"
    raw = RoleTables(spark, sf)[table]
    lines = raw.select("product", F.to_json(F.struct(*[F.col(c).alias(json_key(c)) for c in raw.columns])).alias("line"))
    cut = F.expr("IF(CAST(product AS BIGINT) % 10 = 0, left(line, length(line) - 1), line)")
    lines.select(cut.alias("value")).write.text(f"{folder}/{table}")
    db = _own_database(spark, "raw")
    audit = load_raw(spark, folder, [table], raw_db=db, pattern="*.txt", mode="PERMISSIVE")
    aside = spark.table(f"{db}.quarantine").select(F.col("raw_table").alias("table"), F.lit("aside").alias("what"), F.get_json_object(F.concat("payload", F.lit("}")), "$.product").alias("product"))
    kept = spark.table(f"{db}.{table}").select(F.lit(table).alias("table"), F.lit("kept").alias("what"), "product")
    counted = audit.select("table", F.lit("malformed").alias("what"), F.col("malformed").cast("string").alias("product"))
    found = materialise(aside.unionByName(kept).unionByName(counted), "quarantine")
    spark.sql(f"DROP DATABASE `{db}` CASCADE")
    return found


def _audit_loaded(spark: SparkSession, sf: str, audit: Callable[[dict[str, DataFrame]], DataFrame]) -> DataFrame:
    """An audit of all roles as loaded from JSON lines; it is stored, and the lines are removed."""
    folder = _json_lines(RoleTables(spark, sf))
    found = materialise(audit(read_raw(spark, folder, list(ROLE_SQL), pattern=JSON_FILES)), "audit")
    discard(spark, folder)
    return found


@query
def raw_row_ids(spark, sf):
    """Row ids of the loaded roles: different for each row, none below 0."""
    counts = [F.count("*").alias("n"), F.countDistinct("row_id").alias("n_ids"), (F.min("row_id") >= 0).alias("from_zero")]
    return _audit_loaded(
        spark, sf, lambda raw: union_all([df.agg(*counts).select(F.lit(t).alias("table"), "*") for t, df in raw.items()])
    )


@query
def payload_null_audit(spark, sf):
    return _audit_loaded(spark, sf, integrity.payload_null_audit)


@query
def graph_rebuild(spark, sf):
    """Create all tables, rebuild the graph from orders and products alone, then extend it by all roles."""
    raw = RoleTables(spark, sf)
    raw_db, graph_db = _own_database(spark, "raw"), _own_database(spark, "graph")
    ensure_databases(spark, raw_db, graph_db)
    made = sum(not t.isTemporary for db in (raw_db, graph_db) for t in spark.catalog.listTables(db))
    orders = {"sales_order_headers", "sales_order_items", "products"}
    first = write_graph(spark, {t: raw[t] if t in orders else empty_raw(spark, t) for t in raw}, graph_db)
    added = write_graph(spark, raw, graph_db, truncate=False)
    steps = [("create", "tables", made)]
    steps += [(step, what, n) for step, counts in (("rebuild", first), ("extend", added)) for what, n in counts.items()]
    for db in (raw_db, graph_db):
        spark.sql(f"DROP DATABASE `{db}` CASCADE")
    return spark.createDataFrame(steps, "step string, what string, n bigint")


@query
def graph_increments(spark, sf):
    """The graph after two loads of parts of all roles, each followed by an extension that reads its rows alone.

    Rows of one document are loaded together, as of several statements about it the first one loaded stays.
    """
    raw = RoleTables(spark, sf)
    raw_db, graph_db = _own_database(spark, "raw"), _own_database(spark, "graph")
    ensure_databases(spark, raw_db, graph_db)
    for part in range(2):
        for table in ROLE_SQL:
            by = raw[table].columns[:1] if raw[table].columns[0] != "company_code" else raw[table].columns
            own = raw[table].where(F.expr(f"pmod(xxhash64({', '.join(by)}), 2) = {part}"))
            rows = own.select(F.monotonically_increasing_id().alias("row_id"), F.lit("{}").alias("payload"), "*")
            write_raw(rows, f"{raw_db}.{table}", truncate=False)
        extend_graph(spark, raw_db, graph_db)
    nodes, edges = graph_tables(spark, graph_db)
    keys = nodes.select(F.col("node_type").alias("type"), F.col("node_key").alias("key"))
    found = materialise(keys.unionByName(edges.select(F.col("edge_type").alias("type"), F.col("edge_key").alias("key"))), "increments")
    for db in (raw_db, graph_db):
        spark.sql(f"DROP DATABASE `{db}` CASCADE")
    return found


@query
def incremental_upsert(spark, sf):
    """Deliveries known from items stay as they are when their headers are loaded later."""
    raw = RoleTables(spark, sf)
    before = {**raw, "outbound_delivery_headers": empty_raw(spark, "outbound_delivery_headers")}
    types = ["OutboundDelivery", "Product"]
    before["sales_order_items"] = empty_raw(spark, "sales_order_items")
    existing = build_nodes(before, types)
    added = projection.insert_new(existing, build_nodes(raw, types), "node_key")
    both = existing.withColumn("added", F.lit(False)).unionByName(added.withColumn("added", F.lit(True)))
    return both.select("node_key", "raw_table", "attrs", "added")


@query
def merge_graph_payload(spark, sf):
    """Payload of the payments' neighbours merged into that of the billing documents' neighbours."""
    nodes, edges = stored_graph(spark, sf)
    loaded, _ = traversal.neighbors(nodes, edges, nodes.where("node_type = 'BillingDocument'"), direction="out", include_granular=False)
    new, _ = traversal.neighbors(nodes, edges, nodes.where("node_type = 'Payment'"), direction="in")
    return projection.merge_rows(loaded, new, "node_id").select("node_id", "node_key", "label")


# --------------------------------------------------------------------------- registry


@query
def edge_types_present(spark, sf):
    return registry.edge_types_present(stored_graph(spark, sf)[1])


@query
def edge_type_listing(spark, sf):
    return registry.edge_type_listing(spark, stored_graph(spark, sf)[1])


@query
def relationship_options(spark, sf):
    return registry.relationship_options(registry.edge_type_listing(spark, stored_graph(spark, sf)[1]))


@query
def edges_non_granular(spark, sf):
    return registry.non_granular(stored_graph(spark, sf)[1]).select("edge_key", "edge_type")


@query
def edges_with_type_id(spark, sf):
    return registry.with_type_id(stored_graph(spark, sf)[1]).select("edge_id", "edge_type", "type_id")


# --------------------------------------------------------------------------- graph queries


@query
def node_degrees(spark, sf):
    nodes, edges = stored_graph(spark, sf)
    return traversal.with_degrees(nodes, edges, stored_links(spark, sf)).select("node_key", "in_degree", "out_degree", "total_degree")


@query
def node_detail(spark, sf):
    nodes, edges = stored_graph(spark, sf)
    ids = nodes.where("node_type IN ('Product', 'Payment')").select("node_id")
    return traversal.node_details(nodes, edges, ids, stored_links(spark, sf)).select(
        "node_id", "node_key", "node_type", "label", "in_degree", "out_degree", "total_degree"
    )


@query
def nodes_by_ids(spark, sf):
    nodes, edges = stored_graph(spark, sf)
    ids = edges.where("edge_type = 'CLEARED_BY'").select(F.col("dst_node_id").alias("node_id")).distinct()
    return traversal.nodes_by_ids(nodes, ids).select("node_id", "node_key", "node_type", "label")


@query
def node_id_by_key(spark, sf):
    keys = StarTables(spark, sf)["customer"].selectExpr("concat('Payment:1000|1997|', 1400000000 + c_custkey) AS node_key")
    return traversal.node_id_by_key(stored_graph(spark, sf)[0], keys)


def _first_orders(spark: SparkSession, sf: str) -> list[str]:
    """A request's list: the keys of the first 20 orders."""
    found = StarTables(spark, sf)["orders"].select("o_orderkey").orderBy("o_orderkey").limit(20)
    return [f"SalesOrder:{r[0]}" for r in found.collect()]


def _first_order_ids(spark: SparkSession, sf: str) -> list[str]:
    return [name_id(k) for k in _first_orders(spark, sf)]


@query
def node_by_id(spark, sf):
    found = traversal.nodes_by_ids(stored_graph(spark, sf)[0], _first_order_ids(spark, sf))
    return found.select("node_id", "node_key", "node_type", "label")


@query
def node_detail_by_id(spark, sf):
    found = traversal.node_details(*stored_graph(spark, sf), _first_order_ids(spark, sf), stored_links(spark, sf))
    return found.select("node_id", "node_key", "in_degree", "out_degree", "total_degree")


@query
def node_id_of_keys(spark, sf):
    return traversal.node_id_by_key(stored_graph(spark, sf)[0], _first_orders(spark, sf))


@query
def neighbors_of_ids(spark, sf):
    found = traversal.neighbor_edges(stored_graph(spark, sf)[1], _first_order_ids(spark, sf))
    return found.select("seed_id", "edge_id", "edge_key", "edge_type", "type_id")


@query
def subgraph_of_ids(spark, sf):
    shown, _ = traversal.subgraph(*stored_graph(spark, sf), _first_order_ids(spark, sf), 2)
    return shown.select("node_id", "node_key", "in_degree")


@query
def reach_all(spark, sf):
    """All that hangs together with the incomplete flows, however many steps away."""
    nodes, edges = stored_graph(spark, sf)
    reached = traversal.connected(edges, _broken_seeds(RoleTables(spark, sf)), registry.resolve_codes(include_granular=False))
    return traversal.nodes_by_ids(nodes, reached).select("node_key")


def _neighbors(spark, sf, node_type, **request):
    nodes, edges = stored_graph(spark, sf)
    seeds = nodes.where(F.col("node_type") == node_type)
    found = traversal.neighbor_edges(edges, seeds, **request)
    return found.select("seed_id", "edge_id", "edge_key", "edge_type", "type_id")


@query
def neighbors_out(spark, sf):
    return _neighbors(spark, sf, "SalesOrder", direction="out")


@query
def neighbors_in(spark, sf):
    return _neighbors(spark, sf, "Product", direction="in", limit=20)


@query
def neighbors_both(spark, sf):
    return _neighbors(spark, sf, "OutboundDelivery", direction="both", include_granular=False)


@query
def neighbor_nodes(spark, sf):
    nodes, edges = stored_graph(spark, sf)
    seeds = nodes.where("node_type = 'JournalEntryItemAR'")
    return traversal.neighbors(nodes, edges, seeds, direction="out", limit=1)[0].select("node_id", "node_key")


def _broken_seeds(raw: RoleTables, limit: int | None = None) -> DataFrame:
    flows = templates.broken_flows(raw, limit)
    return flows.select(uuid5("concat('SalesOrder:', salesOrder)").alias("node_id"))


@query
def khop_reach(spark, sf):
    nodes, edges = stored_graph(spark, sf)
    seeds = nodes.where("node_type = 'Payment'")
    reached = traversal.reach(edges, seeds, 6, registry.resolve_codes(include_granular=False), stored_links(spark, sf))
    return reached.join(nodes.select("node_id", "node_key"), "node_id").select("node_key", "depth")


@query
def subgraph_nodes(spark, sf):
    nodes, edges = stored_graph(spark, sf)
    seeds = _broken_seeds(RoleTables(spark, sf))
    return traversal.full_subgraph(nodes, edges, seeds, 2, links=stored_links(spark, sf))[0].select("node_id", "node_key", "label")


@query
def subgraph_edges(spark, sf):
    nodes, edges = stored_graph(spark, sf)
    seeds = _broken_seeds(RoleTables(spark, sf))
    return traversal.full_subgraph(nodes, edges, seeds, 2, links=stored_links(spark, sf))[1].select("edge_id", "edge_key", "type_id")


@query
def subgraph_capped(spark, sf):
    nodes, edges = stored_graph(spark, sf)
    seeds = _broken_seeds(RoleTables(spark, sf), 50)
    shown, _ = traversal.subgraph(nodes, edges, seeds, 3, max_nodes=300, max_edges=400, links=stored_links(spark, sf))
    return shown.select("node_id", "node_key")


@query
def subgraph_capped_edges(spark, sf):
    nodes, edges = stored_graph(spark, sf)
    seeds = _broken_seeds(RoleTables(spark, sf), 50)
    _, kept = traversal.subgraph(nodes, edges, seeds, 3, max_nodes=300, max_edges=400, links=stored_links(spark, sf))
    return kept.select("edge_id", "edge_key", "type_id")


@query
def subgraph_seeds_only(spark, sf):
    nodes, edges = stored_graph(spark, sf)
    seeds = nodes.where("node_type = 'Payment'").select("node_id")
    granular = registry.ids_for_codes(["HAS_ITEM"])
    shown, _ = traversal.subgraph(nodes, edges, seeds, edge_type_ids=granular, include_granular=False)
    return shown.select("node_id", "node_key")


@query
def focus_subgraph(spark, sf):
    nodes, edges = stored_graph(spark, sf)
    key = f"BillingDocument:{largest_document(RoleTables(spark, sf))}"
    focus = nodes.where(F.col("node_key") == key).select("node_id")
    return traversal.focus_subgraph(nodes, edges, focus, links=stored_links(spark, sf))[1].select("edge_id", "edge_key")


@query
def named_edges_of_type(spark, sf):
    _, edges = stored_graph(spark, sf)
    return named.run_named(spark, "edges_of_type", {"edges": edges}, {"edge_type": "POSTED_AS", "limit": 2000}).select(
        "edge_id", "edge_key", "evidence"
    )


@query
def named_node(spark, sf):
    nodes, _ = stored_graph(spark, sf)
    return named.run_named(spark, "node", {"nodes": nodes}, {"node_id": _first_order_ids(spark, sf)[0]}).select("node_id", "node_key")


@query
def named_node_id_by_key(spark, sf):
    nodes, _ = stored_graph(spark, sf)
    return named.run_named(spark, "node_id_by_key", {"nodes": nodes}, {"node_key": _first_orders(spark, sf)[0]})


@query
def named_nodes_by_ids(spark, sf):
    nodes, _ = stored_graph(spark, sf)
    found = named.run_named(spark, "nodes_by_ids", {"nodes": nodes}, {"node_ids": _first_order_ids(spark, sf)})
    return found.select("node_id", "node_key", "node_type", "label")


@query
def named_degrees(spark, sf):
    _, edges = stored_graph(spark, sf)
    return named.run_named(spark, "degrees", {"edges": edges}, {"node_id": _first_order_ids(spark, sf)[0]})


@query
def named_deliveries_of_order(spark, sf):
    raw, order = RoleTables(spark, sf), _first_orders(spark, sf)[0].partition(":")[2]
    return named.run_named(spark, "deliveries_of_order", raw, {"sales_order": order})


# --------------------------------------------------------------------------- audits


@query
def audit_duplicate_keys(spark, sf):
    raw = RoleTables(spark, sf)
    return integrity.repeated_keys(raw["sales_order_items"], ["sales_order", "sales_order_item"])


@query
def audit_unique_constraints(spark, sf):
    """The constraints checked on the candidate rows of all node sources, before conflicts are resolved."""
    raw = RoleTables(spark, sf)
    keys = [source_rows(raw, spec, s).select("node_key") for spec in NODE_SPECS.values() for s in spec.sources]
    return integrity.duplicate_keys(union_all(keys), stored_graph(spark, sf)[1])


@query
def audit_dangling_refs(spark, sf):
    return integrity.dangling_references(RoleTables(spark, sf), stored_graph(spark, sf)[0])


def _described(nodes: DataFrame) -> DataFrame:
    """The nodes that remain when all products without master data are deleted."""
    return nodes.where("node_type <> 'Product' OR raw_table = 'products'")


@query
def audit_dangling_edges(spark, sf):
    nodes, edges = stored_graph(spark, sf)
    return integrity.dangling_edges(_described(nodes), edges).select("edge_key", "missing")


@query
def cascade_edges(spark, sf):
    nodes, edges = stored_graph(spark, sf)
    return integrity.cascade_edges(edges, _described(nodes)).select("edge_key")


@query
def cascade_delete(spark, sf):
    """The stored graph after its products without master data were deleted, with all their edges."""
    db = _own_database(spark, "graph")
    nodes, edges = stored_graph(spark, sf)
    store_graph(nodes, edges, db)
    delete_nodes(spark, nodes.where("node_type = 'Product' AND raw_table <> 'products'").select("node_id"), db)
    nodes, edges = graph_tables(spark, db)
    keys = nodes.select(F.col("node_type").alias("type"), F.col("node_key").alias("key"))
    found = materialise(keys.unionByName(edges.select(F.col("edge_type").alias("type"), F.col("edge_key").alias("key"))), "remaining")
    spark.sql(f"DROP DATABASE `{db}` CASCADE")
    return found


@query
def audit_not_null(spark, sf):
    return integrity.not_null_audit(*stored_graph(spark, sf))


# --------------------------------------------------------------------------- triage


def _all_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Composed questions, conversation turns and documents, whole."""
    star = StarTables(spark, sf)
    return union_all(
        [
            messages(spark, sf).selectExpr("concat('m', message_id) AS message_id", "text"),
            star["conversations"].selectExpr("concat('c', conv_id, '-', turn, '-', role) AS message_id", "text"),
            star["documents"].selectExpr("concat('d', doc_id) AS message_id", "text"),
        ]
    )


@query
def triage_in_domain(spark, sf):
    return triage.triage(_all_texts(spark, sf)).select("message_id", "in_domain")


@query
def triage_route(spark, sf):
    routed = triage.triage(_all_texts(spark, sf))
    return routed.select("message_id", "template", "billing_document", "limit", "rejected", "rejection_reason")


@query
def triage_params(spark, sf):
    return triage.triage(_all_texts(spark, sf)).select("message_id", F.to_json("params").alias("params"))


@query
def triage_not_loaded(spark, sf):
    found = triage.answer(triage.triage(_all_texts(spark, sf)), None)
    return found.select("message_id", "rejected", "rejection_reason", "answer")


@query
def triage_status(spark, sf):
    return triage.status_counts(triage.triage(_all_texts(spark, sf)))


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    return triage.answer(triage.triage(_all_texts(spark, sf)), RoleTables(spark, sf))


@query
def triage_answers(spark, sf):
    return _answers(spark, sf).select("message_id", "template", "rejection_reason", "rows", "row_count", "total_count")


@query
def render_answers(spark, sf):
    return _answers(spark, sf).select("message_id", "answer")


@query
def highlights(spark, sf):
    found = _answers(spark, sf).where("highlights IS NOT NULL")
    return found.select(
        "message_id",
        F.col("highlights.focusNodeId").alias("focus_node_id"),
        F.array_join("highlights.highlightNodeIds", ",").alias("highlight_node_ids"),
    )


# --------------------------------------------------------------------------- display


@query
def overlay_hide_granular(spark, sf):
    return display.hide_granular(stored_graph(spark, sf)[1]).select("edge_id")


@query
def mapping_filter(spark, sf):
    nodes, edges = stored_graph(spark, sf)
    active = registry.ids_for_codes(["POSTED_AS", "CLEARED_BY"])
    shown, _ = display.mapping_filter(nodes, edges, active, _broken_seeds(RoleTables(spark, sf)))
    return shown.select("node_id", "node_key")


@query
def mapping_filter_edges(spark, sf):
    nodes, edges = stored_graph(spark, sf)
    active = registry.ids_for_codes(["POSTED_AS", "CLEARED_BY"])
    return display.mapping_filter(nodes, edges, active)[1].select("edge_id", "edge_type")


@query
def attr_relevance(spark, sf):
    nodes, _ = stored_graph(spark, sf)
    return display.attr_relevance(nodes, "node_id", "attrs", display.NODE_ITEMS)


@query
def edge_attr_relevance(spark, sf):
    _, edges = stored_graph(spark, sf)
    return display.attr_relevance(edges, "edge_id", "evidence", display.EDGE_ITEMS)


@query
def node_card(spark, sf):
    return display.node_cards(*stored_graph(spark, sf), stored_links(spark, sf)).select("node_id", "node_type", "node_key", "connections")


@query
def edge_captions(spark, sf):
    return display.edge_captions(*stored_graph(spark, sf))


@query
def table_preview(spark, sf):
    return display.table_preview(templates.broken_flows(RoleTables(spark, sf)), ["salesOrder"])


@query
def format_values(spark, sf):
    """Word lists of whole texts as tooltip values, with cells of other types."""
    docs = StarTables(spark, sf)["documents"]
    typed = docs.select(
        "doc_id",
        F.split(F.col("text"), " ").alias("words"),
        F.when(F.col("n_chars") > 1000, F.col("n_chars")).alias("long_text"),
        (F.col("lang") == "en").alias("english"),
    )
    return display.format_cells(typed, tooltip=True)
