"""The analytic templates and the sanity checks over raw tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import node_key_skipping_nulls, uuid5
from ..functions.values import present
from ..operators.joins import left_join_many
from ..operators.projection import RawTables, union_all

# Template name -> default limit.
TEMPLATE_LIMITS = {
    "billing_document_to_journal_entry": 10,
    "top_products_by_billing_docs": 10,
    "broken_flows": 50,
}

BILLING_TO_JOURNAL_KEYS = {
    "company_code": "company_code",
    "fiscal_year": "fiscal_year",
    "accounting_document": "accounting_document",
    "reference_document": "billing_document",
}


def _limited(df: DataFrame, order: list, limit: int | None) -> DataFrame:
    return df if limit is None else df.orderBy(*order).limit(limit)


def broken_flows(raw: RawTables, limit: int | None = None) -> DataFrame:
    """Orders whose delivered and billed flags differ: ``salesOrder, delivered, billed``.

    Both flags come from one pass over the delivery items: distinct (order,
    delivery) pairs, marked by the distinct billed deliveries, and reduced to
    one row per order.  Order headers are not de-duplicated.
    """
    pairs = (
        raw["outbound_delivery_items"]
        .where("reference_sd_document IS NOT NULL")
        .select(F.col("reference_sd_document").alias("order_id"), F.col("delivery_document").alias("delivery"))
        .distinct()
    )
    billed = (
        raw["billing_document_items"]
        .where("reference_sd_document IS NOT NULL")
        .select(F.col("reference_sd_document").alias("delivery"))
        .distinct()
        .withColumn("is_billed", F.lit(True))  # after the distinct, whose partitioning the join then reuses
    )
    flags = (
        pairs.join(billed, "delivery", "left")
        .groupBy("order_id")
        .agg(F.expr("coalesce(bool_or(is_billed), false)").alias("any_billed"))
    )
    flows = (
        raw["sales_order_headers"]
        .join(flags, F.col("sales_order") == F.col("order_id"), "left")
        .select(
            F.col("sales_order").alias("salesOrder"),
            F.col("order_id").isNotNull().alias("delivered"),
            F.coalesce("any_billed", F.lit(False)).alias("billed"),
        )
        .where("delivered <> billed")
    )
    return _limited(flows, ["salesOrder"], limit)


def top_products_by_billing_docs(raw: RawTables, limit: int | None = None) -> DataFrame:
    """Distinct billing documents per material, most first: ``product, billingDocumentCount``."""
    counts = (
        raw["billing_document_items"]
        .groupBy(F.col("material").alias("product"))
        .agg(F.countDistinct("billing_document").alias("billingDocumentCount"))
    )
    return _limited(counts, [F.desc("billingDocumentCount"), F.asc_nulls_last("product")], limit)


JOURNAL_NODE_PARTS = ("company_code", "fiscal_year", "accounting_document", "accounting_document_item")


def billing_document_to_journal_entry(
    raw: RawTables,
    billing_document: str | None = None,
    limit: int | None = None,
    nodes: DataFrame | None = None,
) -> DataFrame:
    """Headers with the journal items matching on four keys, and the graph ids of both.

    One document, or all of them.  Without ``nodes`` the ids are computed where
    the raw rows define the nodes; with a stored node table they are given only
    where it holds the node.
    """
    headers = raw["billing_document_headers"]
    if billing_document is not None:
        headers = headers.where(F.col("billing_document") == billing_document)
    entries = raw["journal_entry_items_accounts_receivable"].select(
        *[F.col(c).alias(f"je_{c}") for c in dict.fromkeys([*BILLING_TO_JOURNAL_KEYS, *JOURNAL_NODE_PARTS])]
    )
    on = {header: f"je_{entry}" for entry, header in BILLING_TO_JOURNAL_KEYS.items()}
    je_parts = [f"je_{p}" for p in JOURNAL_NODE_PARTS]
    rows = left_join_many(headers.select(*on), entries, on).select(
        F.col("billing_document").alias("billingDocument"),
        F.col("accounting_document").alias("accountingDocument"),
        node_key_skipping_nulls("BillingDocument", "billing_document").alias("billing_key"),
        node_key_skipping_nulls("JournalEntryItemAR", *je_parts).alias("journal_key"),
        present("billing_document").alias("billing_node"),
        present(*je_parts).alias("journal_node"),
    )
    if nodes is None:
        rows = rows.select(
            "billingDocument",
            "accountingDocument",
            # The condition is on the name: NULL in, NULL out, and the digest is computed once.
            uuid5("(CASE WHEN billing_node THEN billing_key END)").alias("billingDocumentNodeId"),
            uuid5("(CASE WHEN journal_node THEN journal_key END)").alias("journalEntryNodeId"),
        )
    else:
        for key, node_type, out in (
            ("billing_key", "BillingDocument", "billingDocumentNodeId"),
            ("journal_key", "JournalEntryItemAR", "journalEntryNodeId"),
        ):
            lookup = nodes.where(F.col("node_type") == node_type)
            lookup = lookup.select(F.col("node_key").alias(key), F.col("node_id").alias(out))
            rows = rows.join(lookup, key, "left")
        rows = rows.select("billingDocument", "accountingDocument", "billingDocumentNodeId", "journalEntryNodeId")
    return _limited(rows, ["billingDocument", "accountingDocument", "journalEntryNodeId"], limit)


TEMPLATES = {
    "broken_flows": broken_flows,
    "top_products_by_billing_docs": top_products_by_billing_docs,
    "billing_document_to_journal_entry": billing_document_to_journal_entry,
}


def run_template(name: str, raw: RawTables, limit: int | None = None, **params) -> DataFrame:
    """Run a template by name, with its default limit; only registered names are run."""
    if name not in TEMPLATES:
        raise ValueError(f"unknown template: {name!r}")
    return TEMPLATES[name](raw, limit=TEMPLATE_LIMITS[name] if limit is None else limit, **params)


# --------------------------------------------------------------------------- sanity checks

# Label -> table of the row-count check.
COUNTED_TABLES = {
    "sales_order_headers": "sales_order_headers",
    "sales_order_items": "sales_order_items",
    "outbound_delivery_items": "outbound_delivery_items",
    "billing_document_headers": "billing_document_headers",
    "billing_document_items": "billing_document_items",
    "journal_entry_items_ar": "journal_entry_items_accounts_receivable",
    "payments_ar": "payments_accounts_receivable",
}


def row_counts(raw: RawTables) -> DataFrame:
    """``(table, count)`` of the main raw tables."""
    return union_all(
        [raw[t].agg(F.count("*").alias("count")).select(F.lit(label).alias("table"), "count") for label, t in COUNTED_TABLES.items()]
    )


def deliveries_per_order(raw: RawTables, limit: int | None = None) -> DataFrame:
    """Distinct deliveries per order that has any: ``sales_order, delivery_count``.

    The pairs are reduced before the join, which then is an existence check.
    """
    per_order = (
        raw["outbound_delivery_items"]
        .where("reference_sd_document IS NOT NULL")
        .groupBy(F.col("reference_sd_document").alias("sales_order"))
        .agg(F.countDistinct("delivery_document").alias("delivery_count"))
    )
    counts = per_order.join(raw["sales_order_headers"].select("sales_order"), "sales_order", "left_semi")
    return _limited(counts, [F.desc("delivery_count"), F.asc("sales_order")], limit)


def billing_journal_sanity(raw: RawTables, billing_document: str | None = None, limit: int | None = None) -> DataFrame:
    """Headers joined to journal items on the reference alone."""
    headers = raw["billing_document_headers"].select("billing_document", "accounting_document")
    if billing_document is not None:
        headers = headers.where(F.col("billing_document") == billing_document)
    entries = raw["journal_entry_items_accounts_receivable"].select(
        "reference_document", F.col("accounting_document").alias("je_accounting_document")
    )
    out = left_join_many(headers, entries, {"billing_document": "reference_document"})
    out = out.select("billing_document", "accounting_document", "je_accounting_document")
    return _limited(out, ["billing_document", "accounting_document", "je_accounting_document"], limit)


def referenced_materials(raw: RawTables) -> DataFrame:
    """Distinct materials of order and billing items."""
    return (
        raw["sales_order_items"].select("material")
        .union(raw["billing_document_items"].select("material"))
        .where(present("material"))
        .distinct()
    )


def clearing_documents(raw: RawTables) -> DataFrame:
    """Distinct clearing documents with their dates, from journal items and payments."""
    columns = ["company_code", "clearing_doc_fiscal_year", "clearing_accounting_document", "clearing_date"]
    tables = ("journal_entry_items_accounts_receivable", "payments_accounts_receivable")
    rows = union_all([raw[t].where(present(*columns[:3])).select(*columns) for t in tables])
    return rows.distinct().withColumnsRenamed(
        {"clearing_doc_fiscal_year": "fiscal_year", "clearing_accounting_document": "clearing_doc"}
    )
