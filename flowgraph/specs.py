"""The order-to-cash model as plain values: raw tables, node types, edge types.

Table, column, key and label names below are fixed values: results must use
exactly these names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# --------------------------------------------------------------------------- raw tables

# Table (= folder) name and its promoted columns, in order.
RAW_TABLES: dict[str, tuple[str, ...]] = {
    "sales_order_headers": (
        "sales_order", "sold_to_party", "creation_date", "last_change_datetime", "total_net_amount",
        "transaction_currency", "overall_delivery_status", "overall_ord_reltd_billg_status",
    ),
    "sales_order_items": (
        "sales_order", "sales_order_item", "material", "material_group", "requested_quantity",
        "requested_quantity_unit", "net_amount", "transaction_currency", "production_plant", "storage_location",
    ),
    "sales_order_schedule_lines": (
        "sales_order", "sales_order_item", "schedule_line", "confirmed_delivery_date",
        "confd_order_qty_by_matl_avail_check", "order_quantity_unit",
    ),
    "outbound_delivery_headers": (
        "delivery_document", "creation_date", "shipping_point", "overall_goods_movement_status",
        "overall_picking_status",
    ),
    "outbound_delivery_items": (
        "delivery_document", "delivery_document_item", "plant", "storage_location", "actual_delivery_quantity",
        "delivery_quantity_unit", "reference_sd_document", "reference_sd_document_item",
    ),
    "billing_document_headers": (
        "billing_document", "billing_document_type", "billing_document_date", "billing_document_is_cancelled",
        "cancelled_billing_document", "total_net_amount", "transaction_currency", "company_code", "fiscal_year",
        "accounting_document", "sold_to_party",
    ),
    "billing_document_items": (
        "billing_document", "billing_document_item", "material", "billing_quantity", "billing_quantity_unit",
        "net_amount", "transaction_currency", "reference_sd_document", "reference_sd_document_item",
    ),
    "billing_document_cancellations": (
        "billing_document", "billing_document_is_cancelled", "cancelled_billing_document",
    ),
    "journal_entry_items_accounts_receivable": (
        "company_code", "fiscal_year", "accounting_document", "accounting_document_item", "accounting_document_type",
        "gl_account", "reference_document", "customer", "transaction_currency", "amount_in_transaction_currency",
        "posting_date", "document_date", "clearing_date", "clearing_accounting_document", "clearing_doc_fiscal_year",
    ),
    "payments_accounts_receivable": (
        "company_code", "fiscal_year", "accounting_document", "accounting_document_item", "customer",
        "transaction_currency", "amount_in_transaction_currency", "clearing_date", "clearing_accounting_document",
        "clearing_doc_fiscal_year", "invoice_reference", "invoice_reference_fiscal_year",
    ),
    "business_partners": (
        "business_partner", "customer", "business_partner_category", "business_partner_name",
        "business_partner_full_name", "business_partner_grouping", "business_partner_is_blocked",
        "is_marked_for_archiving",
    ),
    "business_partner_addresses": (
        "business_partner", "address_id", "address_uuid", "validity_start_date", "validity_end_date", "street_name",
        "city_name", "region", "country", "postal_code",
    ),
    "customer_company_assignments": (
        "customer", "company_code", "reconciliation_account", "deletion_indicator", "customer_account_group",
    ),
    "customer_sales_area_assignments": (
        "customer", "sales_organization", "distribution_channel", "division", "currency", "customer_payment_terms",
        "incoterms_classification", "incoterms_location1",
    ),
    "products": (
        "product", "product_type", "product_group", "base_unit", "division", "is_marked_for_deletion", "gross_weight",
        "net_weight", "weight_unit",
    ),
    "product_descriptions": (
        "product", "language", "product_description",
    ),
    "plants": (
        "plant", "plant_name", "address_id", "sales_organization", "distribution_channel", "division",
        "is_marked_for_archiving",
    ),
    "product_plants": (
        "product", "plant", "availability_check_type", "profit_center", "mrp_type",
    ),
    "product_storage_locations": (
        "product", "plant", "storage_location", "physical_inventory_block_ind",
        "date_of_last_posted_cnt_un_rstrcd_stk",
    ),
}

# Fixed value: the only JSON key that is not the camel-case form of its column.
_IRREGULAR_KEYS = {"last_change_datetime": "lastChangeDateTime"}


def json_key(column: str) -> str:
    """The JSON key a promoted column is read from."""
    if column in _IRREGULAR_KEYS:
        return _IRREGULAR_KEYS[column]
    head, *rest = column.split("_")
    return head + "".join(w.capitalize() for w in rest)


def promoted_columns(table: str) -> list[str]:
    return list(RAW_TABLES[table])


def raw_schema(table: str) -> T.StructType:
    """Row id, the untouched payload, and the promoted columns as text."""
    return T.StructType(
        [T.StructField("row_id", T.LongType()), T.StructField("payload", T.StringType())]
        + [T.StructField(c, T.StringType()) for c in promoted_columns(table)]
    )


# --------------------------------------------------------------------------- graph tables

NODE_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("node_id", "node_key", "node_type", "raw_table", "label", "attrs")]
)
EDGE_SCHEMA = T.StructType(
    [
        T.StructField(c, T.StringType())
        for c in ("edge_id", "edge_key", "src_node_id", "dst_node_id", "edge_type", "evidence")
    ]
)


@dataclass(frozen=True)
class NodeSource:
    """One raw table that defines nodes: key columns and attribute name -> column.

    Of several rows with one key the lowest ``rank`` wins, then the smallest
    attribute values.
    """

    table: str
    keys: tuple[str, ...]
    attrs: dict[str, str]
    rank: int = 0


@dataclass(frozen=True)
class NodeSpec:
    node_type: str
    label: str
    sources: tuple[NodeSource, ...]

    @property
    def attr_names(self) -> list[str]:
        return list(dict.fromkeys(a for s in self.sources for a in s.attrs))


def _attrs(*names: str, **renamed: str) -> dict[str, str]:
    """Attribute names whose columns follow the camel-case rule; ``renamed`` gives the others."""
    by_key: dict[str, str] = {}
    for table in RAW_TABLES:
        for column in promoted_columns(table):
            by_key[json_key(column)] = column
    return {n: renamed.get(n) or by_key[n] for n in names}


_PAYMENT_KEYS = ("company_code", "clearing_doc_fiscal_year", "clearing_accounting_document")
_PAYMENT_ATTRS = _attrs(
    "companyCode", "fiscalYear", "clearingAccountingDocument", "clearingDate",
    fiscalYear="clearing_doc_fiscal_year",
)
_JOURNAL_KEYS = ("company_code", "fiscal_year", "accounting_document", "accounting_document_item")

# Node types, labels and attribute names.
NODE_SPECS: dict[str, NodeSpec] = {
    spec.node_type: spec
    for spec in (
        NodeSpec(
            "SalesOrder",
            "SO {salesOrder}",
            (
                NodeSource(
                    "sales_order_headers",
                    ("sales_order",),
                    _attrs(
                        "salesOrder", "soldToParty", "creationDate", "totalNetAmount", "transactionCurrency",
                        "overallDeliveryStatus", "overallBillingStatus",
                        overallBillingStatus="overall_ord_reltd_billg_status",
                    ),
                ),
            ),
        ),
        NodeSpec(
            "SalesOrderItem",
            "SO Item {salesOrder}/{salesOrderItem}",
            (
                NodeSource(
                    "sales_order_items",
                    ("sales_order", "sales_order_item"),
                    _attrs(
                        "salesOrder", "salesOrderItem", "material", "requestedQuantity",
                        "requestedQuantityUnit", "netAmount", "transactionCurrency", "productionPlant",
                        "storageLocation",
                    ),
                ),
            ),
        ),
        NodeSpec(
            "OutboundDelivery",
            "Delivery {deliveryDocument}",
            (
                NodeSource(
                    "outbound_delivery_headers",
                    ("delivery_document",),
                    _attrs(
                        "deliveryDocument", "creationDate", "shippingPoint", "overallGoodsMovementStatus",
                        "overallPickingStatus",
                    ),
                ),
                NodeSource("outbound_delivery_items", ("delivery_document",), _attrs(
                    "deliveryDocument",
                ), rank=1),
            ),
        ),
        NodeSpec(
            "OutboundDeliveryItem",
            "Delivery Item {deliveryDocument}/{deliveryDocumentItem}",
            (
                NodeSource(
                    "outbound_delivery_items",
                    ("delivery_document", "delivery_document_item"),
                    _attrs(
                        "deliveryDocument", "deliveryDocumentItem", "referenceSalesOrder",
                        "referenceSalesOrderItem", "plant", "storageLocation", "actualDeliveryQuantity",
                        "deliveryQuantityUnit",
                        referenceSalesOrder="reference_sd_document",
                        referenceSalesOrderItem="reference_sd_document_item",
                    ),
                ),
            ),
        ),
        NodeSpec(
            "BillingDocument",
            "Billing {billingDocument}",
            (
                NodeSource(
                    "billing_document_headers",
                    ("billing_document",),
                    _attrs(
                        "billingDocument", "billingDocumentType", "billingDocumentDate", "totalNetAmount",
                        "transactionCurrency", "companyCode", "fiscalYear", "accountingDocument", "soldToParty",
                        "isCancelled", "cancelledBillingDocument",
                        isCancelled="billing_document_is_cancelled",
                    ),
                ),
            ),
        ),
        NodeSpec(
            "BillingDocumentItem",
            "Billing Item {billingDocument}/{billingDocumentItem}",
            (
                NodeSource(
                    "billing_document_items",
                    ("billing_document", "billing_document_item"),
                    _attrs(
                        "billingDocument", "billingDocumentItem", "material", "billingQuantity",
                        "billingQuantityUnit", "netAmount", "transactionCurrency", "referenceDelivery",
                        "referenceDeliveryItem",
                        referenceDelivery="reference_sd_document",
                        referenceDeliveryItem="reference_sd_document_item",
                    ),
                ),
            ),
        ),
        NodeSpec(
            "JournalEntryItemAR",
            "Journal {accountingDocument} (Item {accountingDocumentItem})",
            (
                NodeSource(
                    "journal_entry_items_accounts_receivable",
                    _JOURNAL_KEYS,
                    _attrs(
                        "companyCode", "fiscalYear", "accountingDocument", "accountingDocumentItem",
                        "accountingDocumentType", "glAccount", "referenceDocument", "customer",
                        "transactionCurrency", "amountInTransactionCurrency", "postingDate", "documentDate",
                        "clearingDate", "clearingAccountingDocument", "clearingDocFiscalYear",
                    ),
                ),
            ),
        ),
        NodeSpec(
            "Product",
            "Product {product}",
            (
                NodeSource(
                    "products", ("product",), _attrs(
                        "product", "productType", "productGroup", "baseUnit", "division",
                    )
                ),
                NodeSource("sales_order_items", ("material",), {"product": "material"}, rank=1),
                NodeSource("billing_document_items", ("material",), {"product": "material"}, rank=1),
            ),
        ),
        NodeSpec(
            "Payment",
            "Payment {clearingAccountingDocument}",
            (
                NodeSource("journal_entry_items_accounts_receivable", _PAYMENT_KEYS, _PAYMENT_ATTRS),
                NodeSource("payments_accounts_receivable", _PAYMENT_KEYS, _PAYMENT_ATTRS),
            ),
        ),
    )
}


@dataclass(frozen=True)
class Endpoint:
    """An edge end: node type and key parts, as columns or SQL expressions of the source."""

    node_type: str
    keys: tuple[str, ...]


@dataclass(frozen=True)
class EdgeSpec:
    """One edge rule.

    ``source`` is a raw table, or with ``from_nodes`` a node type whose
    surviving rows (one per key) are read instead.  ``required`` columns must
    be present; ``evidence`` maps names to source columns.
    """

    name: str
    code: str
    source: str
    src: Endpoint
    dst: Endpoint
    evidence: dict[str, str]
    required: tuple[str, ...] = field(default=())
    from_nodes: bool = False


_ORDER_ITEM = ("salesOrder", "salesOrderItem")
_BILLING_ITEM = ("billingDocument", "billingDocumentItem")

# Edge rules and evidence names.
EDGE_SPECS: dict[str, EdgeSpec] = {
    spec.name: spec
    for spec in (
        EdgeSpec(
            "has_item_order",
            "HAS_ITEM",
            "SalesOrderItem",
            Endpoint("SalesOrder", ("salesOrder",)),
            Endpoint("SalesOrderItem", _ORDER_ITEM),
            {"salesOrder": "salesOrder", "salesOrderItem": "salesOrderItem"},
            from_nodes=True,
        ),
        EdgeSpec(
            "delivered_as",
            "DELIVERED_AS",
            "outbound_delivery_items",
            Endpoint("SalesOrder", ("reference_sd_document",)),
            Endpoint("OutboundDelivery", ("delivery_document",)),
            {"salesOrder": "reference_sd_document", "deliveryDocument": "delivery_document"},
            ("reference_sd_document", "delivery_document"),
        ),
        EdgeSpec(
            "has_item_delivery",
            "HAS_ITEM",
            "outbound_delivery_items",
            Endpoint("OutboundDelivery", ("delivery_document",)),
            Endpoint("OutboundDeliveryItem", ("delivery_document", "delivery_document_item")),
            {"deliveryDocument": "delivery_document", "deliveryDocumentItem": "delivery_document_item"},
            ("delivery_document",),
        ),
        EdgeSpec(
            "fulfilled_by",
            "FULFILLED_BY",
            "outbound_delivery_items",
            Endpoint(
                "SalesOrderItem",
                ("reference_sd_document", "trim(LEADING '0' FROM reference_sd_document_item)"),
            ),
            Endpoint("OutboundDeliveryItem", ("delivery_document", "delivery_document_item")),
            {
                "salesOrder": "reference_sd_document",
                "salesOrderItem": "reference_sd_document_item",
                "deliveryDocument": "delivery_document",
            },
            ("reference_sd_document", "reference_sd_document_item", "delivery_document"),
        ),
        EdgeSpec(
            "has_item_billing",
            "HAS_ITEM",
            "billing_document_items",
            Endpoint("BillingDocument", ("billing_document",)),
            Endpoint("BillingDocumentItem", ("billing_document", "billing_document_item")),
            {"billingDocument": "billing_document", "billingDocumentItem": "billing_document_item"},
            ("billing_document",),
        ),
        EdgeSpec(
            "billed_as",
            "BILLED_AS",
            "billing_document_items",
            Endpoint("OutboundDelivery", ("reference_sd_document",)),
            Endpoint("BillingDocument", ("billing_document",)),
            {"deliveryDocument": "reference_sd_document", "billingDocument": "billing_document"},
            ("reference_sd_document", "billing_document"),
        ),
        EdgeSpec(
            "billed_by",
            "BILLED_BY",
            "billing_document_items",
            Endpoint(
                "OutboundDeliveryItem",
                ("reference_sd_document", "lpad(reference_sd_document_item, 6, '0')"),
            ),
            Endpoint("BillingDocumentItem", ("billing_document", "billing_document_item")),
            {"deliveryDocument": "reference_sd_document", "billingDocument": "billing_document"},
            ("reference_sd_document", "reference_sd_document_item", "billing_document"),
        ),
        EdgeSpec(
            "posted_as",
            "POSTED_AS",
            "journal_entry_items_accounts_receivable",
            Endpoint("BillingDocument", ("reference_document",)),
            Endpoint("JournalEntryItemAR", _JOURNAL_KEYS),
            {"billingDocument": "reference_document", "accountingDocument": "accounting_document"},
            ("reference_document",),
        ),
        EdgeSpec(
            "cleared_by",
            "CLEARED_BY",
            "journal_entry_items_accounts_receivable",
            Endpoint("JournalEntryItemAR", _JOURNAL_KEYS),
            Endpoint("Payment", _PAYMENT_KEYS),
            {
                "clearingAccountingDocument": "clearing_accounting_document",
                "clearingDocFiscalYear": "clearing_doc_fiscal_year",
                "clearingDate": "clearing_date",
            },
            ("clearing_accounting_document", "clearing_doc_fiscal_year"),
        ),
        EdgeSpec(
            "order_item_refers_to_product",
            "REFERS_TO_PRODUCT",
            "SalesOrderItem",
            Endpoint("SalesOrderItem", _ORDER_ITEM),
            Endpoint("Product", ("material",)),
            {"material": "material"},
            ("material",),
            from_nodes=True,
        ),
        EdgeSpec(
            "billing_item_refers_to_product",
            "REFERS_TO_PRODUCT",
            "BillingDocumentItem",
            Endpoint("BillingDocumentItem", _BILLING_ITEM),
            Endpoint("Product", ("material",)),
            {"material": "material"},
            ("material",),
            from_nodes=True,
        ),
    )
}


# --------------------------------------------------------------------------- edge types

# Code, display name, description, source type, target type, granular, group.
EDGE_TYPES: tuple[tuple[str, str, str, str | None, str | None, bool, str], ...] = (
    ("PLACED_ORDER", "Customer placed order", "Customer placed a sales order", "Customer", "SalesOrder",
     False, "o2c_flow"),
    ("DELIVERED_AS", "Sales order delivered as delivery", "Sales order fulfilled by an outbound delivery",
     "SalesOrder", "OutboundDelivery", False, "o2c_flow"),
    ("HAS_ITEM", "Document has item", "Parent document contains line-items", None, None, True, "o2c_flow"),
    ("FULFILLED_BY", "Order item fulfilled by delivery item",
     "Sales order item fulfilled by outbound delivery item", "SalesOrderItem", "OutboundDeliveryItem",
     True, "o2c_flow"),
    ("BILLED_BY", "Delivery item billed by billing item",
     "Outbound delivery item billed by billing document item", "OutboundDeliveryItem", "BillingDocumentItem",
     True, "o2c_flow"),
    ("BILLED_AS", "Delivery billed as billing document", "Outbound delivery billed into a billing document",
     "OutboundDelivery", "BillingDocument", False, "o2c_flow"),
    ("POSTED_AS", "Billing posted as journal entry", "Billing document posted into accounting/journal entry",
     "BillingDocument", "JournalEntryItemAR", False, "finance"),
    ("CLEARED_BY", "AR item cleared by payment",
     "Journal entry AR item cleared by a payment/clearing document", "JournalEntryItemAR", "Payment",
     False, "finance"),
    ("REFERS_TO_PRODUCT", "Item refers to product", "Document item references a product/material", None,
     "Product", True, "master_data"),
)
