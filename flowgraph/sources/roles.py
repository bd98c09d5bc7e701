"""Star-schema tables in the roles of the raw order-to-cash tables.

Each role is one portable SELECT over whole tables; gaps (documents without a
header, open items, products without master data) come from business columns.
All columns are text, as promoted columns are.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from ..specs import RAW_TABLES
from .jsonl import conform

_DAY = "CONCAT(CAST(CAST({0} AS DATE) AS STRING), 'T00:00:00.000Z')"
_MONEY = "CAST(CAST({0} AS DECIMAL(18,2)) AS STRING)"
_DELIVERY = "CONCAT('D', CAST(l_orderkey AS STRING), CASE WHEN l_quantity > 25 THEN '-B' ELSE '-P' END)"
_BILLING = "CAST(10000000 + {0} AS STRING)"
_ACCOUNTING = "CAST(940000000 + o_orderkey AS STRING)"

_LINE_ITEM = "lpad(CAST(l_linenumber AS STRING), 6, '0')"


def _journal_item(item: str, above: int) -> str:
    """Journal items of finished orders; orders of a high value have a second one."""
    return f"""
SELECT '1000' AS company_code,
  CAST(year(o_orderdate) + CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END AS STRING) AS fiscal_year,
  {_ACCOUNTING} AS accounting_document, '{item}' AS accounting_document_item,
  {_BILLING.format('o_orderkey')} AS reference_document, CAST(o_custkey AS STRING) AS customer,
  'INR' AS transaction_currency, {_MONEY.format('o_totalprice')} AS amount_in_transaction_currency,
  {_DAY.format('o_orderdate')} AS posting_date, {_DAY.format('o_orderdate')} AS clearing_date,
  CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE CAST(1400000000 + o_custkey AS STRING) END
    AS clearing_accounting_document,
  CAST(year(o_orderdate) AS STRING) AS clearing_doc_fiscal_year
FROM {{orders}} WHERE o_orderstatus = 'F' AND o_totalprice > {above}"""


ROLE_SQL: dict[str, str] = {
    "sales_order_headers": f"""
SELECT CAST(o_orderkey AS STRING) AS sales_order, CAST(o_custkey AS STRING) AS sold_to_party,
  {_DAY.format('o_orderdate')} AS creation_date, {_MONEY.format('o_totalprice')} AS total_net_amount,
  'INR' AS transaction_currency, o_orderstatus AS overall_delivery_status,
  '' AS overall_ord_reltd_billg_status
FROM {{orders}}""",
    "sales_order_items": f"""
SELECT CAST(l_orderkey AS STRING) AS sales_order, CAST(l_linenumber AS STRING) AS sales_order_item,
  CAST(l_partkey AS STRING) AS material, {_MONEY.format('l_quantity')} AS requested_quantity,
  'PC' AS requested_quantity_unit, {_MONEY.format('l_extendedprice')} AS net_amount,
  'INR' AS transaction_currency
FROM {{lineitem}}""",
    "outbound_delivery_items": f"""
SELECT {_DELIVERY} AS delivery_document, {_LINE_ITEM} AS delivery_document_item,
  CAST(l_suppkey AS STRING) AS plant, {_MONEY.format('l_quantity')} AS actual_delivery_quantity,
  'PC' AS delivery_quantity_unit, CAST(l_orderkey AS STRING) AS reference_sd_document,
  {_LINE_ITEM} AS reference_sd_document_item
FROM {{lineitem}} WHERE l_linestatus = 'F'""",
    "outbound_delivery_headers": f"""
SELECT {_DELIVERY} AS delivery_document, {_DAY.format('l_shipdate')} AS creation_date,
  l_returnflag AS overall_goods_movement_status
FROM {{lineitem}} WHERE l_linestatus = 'F' AND l_discount > 0.03""",
    "billing_document_headers": f"""
SELECT {_BILLING.format('o_orderkey')} AS billing_document, 'F2' AS billing_document_type,
  {_DAY.format('o_orderdate')} AS billing_document_date, 'false' AS billing_document_is_cancelled,
  '' AS cancelled_billing_document, {_MONEY.format('o_totalprice')} AS total_net_amount,
  'INR' AS transaction_currency, '1000' AS company_code, CAST(year(o_orderdate) AS STRING) AS fiscal_year,
  {_ACCOUNTING} AS accounting_document, CAST(o_custkey AS STRING) AS sold_to_party
FROM {{orders}} WHERE o_orderpriority <> '1-URGENT'""",
    "billing_document_items": f"""
SELECT {_BILLING.format('l_orderkey')} AS billing_document, CAST(l_linenumber AS STRING) AS billing_document_item,
  CAST(l_partkey AS STRING) AS material, {_MONEY.format('l_quantity')} AS billing_quantity,
  'PC' AS billing_quantity_unit, {_MONEY.format('l_extendedprice')} AS net_amount,
  'INR' AS transaction_currency, {_DELIVERY} AS reference_sd_document,
  CAST(l_linenumber AS STRING) AS reference_sd_document_item
FROM {{lineitem}} WHERE l_linestatus = 'F' AND l_returnflag <> 'R'""",
    "journal_entry_items_accounts_receivable": f"{_journal_item('1', 0)} UNION ALL {_journal_item('2', 300000)}",
    "payments_accounts_receivable": f"""
SELECT '1000' AS company_code, CAST(year(ts) AS STRING) AS clearing_doc_fiscal_year,
  CAST(1400000000 + user_id AS STRING) AS clearing_accounting_document,
  {_DAY.format('ts')} AS clearing_date, CAST(user_id AS STRING) AS customer
FROM {{events}} WHERE event_type = 'purchase'""",
    "products": """
SELECT CAST(p_partkey AS STRING) AS product, p_type AS product_type, p_brand AS product_group, 'PC' AS base_unit
FROM {part} WHERE p_size < 48""",
    "product_descriptions": """
SELECT CAST(p_partkey AS STRING) AS product, l.language AS language,
  CASE WHEN l.note = '' THEN p_name ELSE CONCAT(p_name, l.note) END AS product_description
FROM {part} JOIN (
  SELECT 'LARGE' AS kind, 'EN' AS language, '' AS note UNION ALL SELECT 'MEDIUM', 'EN', ''
  UNION ALL SELECT 'PROMO', 'EN', ' (promo)' UNION ALL SELECT 'PROMO', 'EN', ''
  UNION ALL SELECT 'SMALL', 'EN', '' UNION ALL SELECT 'SMALL', 'DE', ' (klein)'
  UNION ALL SELECT 'ECONOMY', 'DE', '') l
  ON p_type = l.kind""",
}

STAR_TABLES = ("orders", "lineitem", "part", "customer", "events", "conversations", "documents")

# Triage messages composed from the orders, one per order.
MESSAGE_SQL = f"""
SELECT o_orderkey AS message_id, CASE
  WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'
    THEN CONCAT('  What happened to delivery ', {_BILLING.format('o_orderkey')}, ' ')
  WHEN o_orderpriority = '1-URGENT' THEN 'Which products have the HIGHEST number of billing documents?'
  WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'O' THEN 'Write a story about a dragon'
  WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'P' THEN 'Show sales orders with broken or incomplete flows'
  WHEN o_orderpriority = '3-MEDIUM' THEN 'List every customer'
  ELSE CONCAT({_BILLING.format('o_orderkey')}, ' - Find the journal entry linked to this?') END AS text
FROM {{orders}}"""

class StarTables(Mapping):
    """The star tables of a folder; a table is opened when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self._open: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._open:
            self._open[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._open[name]

    def __iter__(self):
        return iter(STAR_TABLES)

    def __len__(self) -> int:
        return len(STAR_TABLES)

    def sql(self, text: str) -> DataFrame:
        """Run portable SQL; only the tables named in it as ``{table}`` are bound."""
        return self.spark.sql(text, **{n: self[n] for n in STAR_TABLES if f"{{{n}}}" in text})


class RoleTables(Mapping):
    """All raw tables: roles over the star tables, the others empty; made when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.star = StarTables(spark, sf_dir)
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, table: str) -> DataFrame:
        if table not in RAW_TABLES:
            raise KeyError(table)
        if table not in self._made:
            role = self.star.sql(ROLE_SQL[table]) if table in ROLE_SQL else self.star.spark.range(0)
            self._made[table] = conform(role, table)
        return self._made[table]

    def __iter__(self):
        return iter(RAW_TABLES)

    def __len__(self) -> int:
        return len(RAW_TABLES)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(message_id, text)``: one composed question per order."""
    return StarTables(spark, sf_dir).sql(MESSAGE_SQL)
