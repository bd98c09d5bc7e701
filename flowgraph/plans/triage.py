"""Question triage over a table of messages ``(message_id, text)``.

Each message is tested for the domain, routed to a template by rules, and
answered from the template's rows.  All of it is column expressions and joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import strip_text
from ..operators.projection import RawTables
from ..operators.ranking import top_n_per_group
from ..session import materialise
from .templates import TEMPLATE_LIMITS, billing_document_to_journal_entry, broken_flows, top_products_by_billing_docs

# Keywords of the domain, id patterns, and the texts of answers.
DOMAIN_KEYWORDS = (
    "order", "sales order", "delivery", "outbound", "billing", "invoice", "payment", "journal", "accounting",
    "customer", "business partner", "product", "material", "plant",
)
DOCUMENT_ID = r"(?U)\b\d{6,10}\b"
BILLING_ID = r"(?U)\b(\d{8})\b"

OUT_OF_DOMAIN = "This system is designed to answer questions related to the provided dataset only."
UNSUPPORTED = "I can’t map that question to a supported dataset query yet."
NOT_LOADED = (
    "Dataset/graph tables are not available yet. Load the dataset into Postgres and rebuild the graph projection."
)
NO_ROWS = "No results found in the dataset for that query."
LINKED = "The journal entry number linked to billing document {} is {}."
NOT_LINKED = "I found billing document {}, but no linked journal entry was returned."
TOP_HEADING = "Top products by number of billing documents:"
FLOWS_FOUND = "Found {} sales orders with incomplete flows (sample shown in the table)."
TOP_SHOWN = 5

JOURNAL, TOP, FLOWS = "billing_document_to_journal_entry", "top_products_by_billing_docs", "broken_flows"


def _any_of(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def in_domain(text: Column) -> Column:
    """A domain keyword occurs anywhere, also inside a word, or a number of 6 to 10 digits stands alone."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return _any_of(low, DOMAIN_KEYWORDS) | low.rlike(DOCUMENT_ID)


def billing_id(text: Column) -> Column:
    """The first free-standing number of exactly 8 digits, or NULL."""
    return F.nullif(F.regexp_extract(text, BILLING_ID, 1), F.lit(""))


def route(text: Column) -> Column:
    """The template of a message by ordered rules, or NULL."""
    low = F.lower(text)
    return (
        F.when(billing_id(text).isNotNull() & _any_of(low, ("journal", "accounting")), JOURNAL)
        .when(
            low.contains("highest") & _any_of(low, ("billing", "invoice")) & _any_of(low, ("product", "material")),
            TOP,
        )
        .when(_any_of(low, ("broken", "incomplete")), FLOWS)
    )


def triage(messages: DataFrame) -> DataFrame:
    """``message_id, text, in_domain, template, billing_document, params, limit, rejected, rejection_reason``."""
    limits = F.create_map(*[F.lit(x) for pair in TEMPLATE_LIMITS.items() for x in pair])
    checked = messages.select("message_id", strip_text(F.coalesce("text", F.lit(""))).alias("text"))
    checked = checked.withColumn("in_domain", in_domain(F.col("text")))
    routed = checked.withColumn("template", F.when(F.col("in_domain"), route(F.col("text"))))
    document = F.when(F.col("template") == JOURNAL, billing_id(F.col("text")))
    no_params = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    reason = F.when(~F.col("in_domain"), "out_of_domain").when(F.col("template").isNull(), "unsupported_query")
    return (
        routed.withColumn("billing_document", document)
        .withColumn(
            "params",
            F.when(F.col("template") == JOURNAL, F.create_map(F.lit("billing_document"), "billing_document")).when(
                F.col("template").isNotNull(), no_params
            ),
        )
        .withColumn("limit", F.when(F.col("template").isNotNull(), limits[F.col("template")]))
        .withColumn("rejection_reason", reason)
        .withColumn("rejected", F.col("rejection_reason").isNotNull())
    )


def status_counts(triaged: DataFrame) -> DataFrame:
    """Messages per outcome: the template, or the reason of the rejection."""
    outcome = F.coalesce("rejection_reason", "template").alias("outcome")
    return triaged.groupBy(outcome).agg(F.count("*").alias("n"))


# --------------------------------------------------------------------------- highlights


def as_uuid(text: Column) -> Column:
    """The canonical form of a UUID in any usual notation; NULL for other text."""
    bare = F.replace(F.replace(text, F.lit("urn:"), F.lit("")), F.lit("uuid:"), F.lit(""))
    digits = F.lower(F.replace(F.btrim(bare, F.lit("{}")), F.lit("-"), F.lit("")))
    dashed = F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(digits.rlike("^[0-9a-f]{32}$"), dashed)


def _ids(rows: Column, fields: list[str]) -> Column:
    """Valid ids in the named fields of an array of rows, row by row, each once."""
    if not fields:
        return F.array().cast("array<string>")
    per_row = F.transform(rows, lambda r: F.array(*[as_uuid(r[f]) for f in fields]))
    return F.array_distinct(F.filter(F.flatten(per_row), lambda i: i.isNotNull()))


def highlights(rows: Column, dtype: T.ArrayType) -> Column:
    """``struct(focusNodeId, highlightNodeIds, highlightEdgeIds)`` of result rows; NULL if there are no ids.

    Ids come from the columns named ``…nodeId`` and ``…edgeId``; the focus is
    the first node id in row and column order.
    """
    names = dtype.elementType.fieldNames()
    nodes = _ids(rows, [n for n in names if n.lower().endswith("nodeid")])
    edges = _ids(rows, [n for n in names if n.lower().endswith("edgeid")])
    found = F.struct(
        F.get(nodes, F.lit(0)).alias("focusNodeId"),
        nodes.alias("highlightNodeIds"),
        edges.alias("highlightEdgeIds"),
    )
    return F.when((F.size(nodes) > 0) | (F.size(edges) > 0), found)


# --------------------------------------------------------------------------- answers


def _text(template: str, *args: Column) -> Column:
    first, *rest = template.split("{}")
    pieces = [F.lit(first)]
    for arg, after in zip(args, rest):
        pieces += [arg.cast("string"), F.lit(after)]
    return F.concat(*pieces)


def _top_line(row: Column) -> Column:
    product = F.coalesce(F.nullif(row["product"], F.lit("")), F.lit("None"))
    return F.concat(F.lit("- "), product, F.lit(": "), row["billingDocumentCount"].cast("string"))


def render_answer(template: str, rows: Column, document: Column | None = None) -> Column:
    """The answer text of a template from its (limited, ordered) rows."""
    n = F.size(rows)
    if template == JOURNAL:
        linked = F.nullif(F.get(rows, F.lit(0))["accountingDocument"], F.lit(""))
        text = F.when(linked.isNotNull(), _text(LINKED, document, linked)).otherwise(_text(NOT_LINKED, document))
    elif template == TOP:
        lines = F.transform(F.slice(rows, 1, TOP_SHOWN), _top_line)
        text = F.concat(F.lit(TOP_HEADING + "\n"), F.array_join(lines, "\n"))
    else:
        text = _text(FLOWS_FOUND, n)
    return F.when(n > 0, text).otherwise(F.lit(NO_ROWS))


def _result(grouped: DataFrame, template: str, document: Column | None = None) -> DataFrame:
    """Rows of one template (array column ``rows``) -> answer, table and highlights."""
    dtype = grouped.schema["rows"].dataType
    names = dtype.elementType.fieldNames()
    rows = F.col("rows")
    keep = [c for c in grouped.columns if c != "rows"]
    columns = F.when(F.size(rows) > 0, F.array(*[F.lit(n) for n in names])).otherwise(F.array().cast("array<string>"))
    return grouped.select(
        *keep,
        F.lit(template).alias("template"),
        render_answer(template, rows, document).alias("answer"),
        columns.alias("columns"),
        F.to_json(rows, {"ignoreNullFields": "false"}).alias("rows"),
        F.size(rows).alias("row_count"),
        highlights(rows, dtype).alias("highlights"),
    )


def fixed_answers(raw: RawTables) -> DataFrame:
    """One row each for the templates without parameters; their limits bound its size.

    The whole results are written once; the shown rows and their total number are read from there.
    """
    all_top = materialise(top_products_by_billing_docs(raw), "top")
    all_flows = materialise(broken_flows(raw), "flows")
    top = all_top.orderBy(F.desc("billingDocumentCount"), F.asc_nulls_last("product")).limit(TEMPLATE_LIMITS[TOP])
    flows = all_flows.orderBy("salesOrder").limit(TEMPLATE_LIMITS[FLOWS])
    top_rows = top.agg(
        F.expr(
            "transform(array_sort(collect_list(struct(-billingDocumentCount AS o, product IS NULL AS z,"
            " product, billingDocumentCount))), r -> struct(r.product, r.billingDocumentCount)) AS rows"
        )
    )
    flow_rows = flows.agg(F.expr("array_sort(collect_list(struct(salesOrder, delivered, billed))) AS rows"))
    top_rows = top_rows.withColumn("total_count", all_top.agg(F.count("*")).scalar())
    flow_rows = flow_rows.withColumn("total_count", all_flows.agg(F.count("*")).scalar())
    return _result(top_rows, TOP).unionByName(_result(flow_rows, FLOWS))


def journal_answers(documents: DataFrame, raw: RawTables) -> DataFrame:
    """One row per billing document that has a header: ``billing_document`` + result columns.

    Rows are cut to the template's limit per document before they are
    collected, and before any message is joined to them; their number before
    the cut is counted.
    """
    wanted = documents.select("billing_document").distinct()
    headers = raw["billing_document_headers"].join(wanted, "billing_document", "left_semi")
    found = billing_document_to_journal_entry(
        {
            "billing_document_headers": headers,
            "journal_entry_items_accounts_receivable": raw["journal_entry_items_accounts_receivable"],
        }
    )
    found = materialise(found, "links")
    totals = found.groupBy(F.col("billingDocument").alias("_document")).agg(F.count("*").alias("total_count"))
    order = [F.col("accountingDocument"), F.col("journalEntryNodeId")]
    first = top_n_per_group(found, ["billingDocument"], order, TEMPLATE_LIMITS[JOURNAL])
    names = "billingDocument, accountingDocument, billingDocumentNodeId, journalEntryNodeId"
    rows = first.groupBy(F.col("billingDocument").alias("billing_document")).agg(
        F.expr(
            f"transform(array_sort(collect_list(struct(rank, {names}))),"
            f" r -> struct({', '.join('r.' + n for n in names.split(', '))})) AS rows"
        )
    )
    rows = rows.join(totals, F.col("billing_document") == F.col("_document")).drop("_document")
    return _result(rows, JOURNAL, F.col("billing_document"))


RESULT_COLUMNS = ["answer", "columns", "rows", "row_count", "total_count", "highlights"]


def answer(triaged: DataFrame, raw: RawTables | None) -> DataFrame:
    """Answers for all messages: ``message_id, template, rejected, rejection_reason, answer, columns, rows,
    row_count, total_count, highlights``.

    ``row_count`` and the text count the rows shown, up to the template's
    limit; ``total_count`` counts all. Routing and results are written when
    this is called.
    With ``raw`` None (nothing loaded) the routed messages are rejected as
    ``data_not_loaded``.
    """
    if raw is None:
        reason = F.coalesce("rejection_reason", F.lit("data_not_loaded"))
        out = triaged.withColumn("rejection_reason", reason).withColumn("rejected", F.lit(True))
        shape = {"answer": "string", "columns": "array<string>", "rows": "string", "row_count": "int", "total_count": "bigint"}
        out = out.withColumns({c: F.lit(None).cast(t) for c, t in shape.items()})
        ids = "struct<focusNodeId:string,highlightNodeIds:array<string>,highlightEdgeIds:array<string>>"
        return _finish(out.withColumn("highlights", F.lit(None).cast(ids)))

    # The texts are read once: what follows works on the narrow routing result.
    triaged = materialise(triaged.drop("text", "params", "limit"), "triaged")
    fixed = F.broadcast(fixed_answers(raw).select("template", F.struct(*RESULT_COLUMNS).alias("fixed")))
    documents = triaged.where(F.col("billing_document").isNotNull())
    by_document = journal_answers(documents, raw).select(
        F.col("billing_document").alias("answered_document"), F.struct(*RESULT_COLUMNS).alias("linked")
    )
    # Messages without a document get a key of their own, so they spread over the join's partitions.
    spread = F.coalesce("billing_document", F.concat(F.lit("#"), F.col("message_id").cast("string")))
    joined = (
        triaged.withColumn("lookup", spread)
        .join(by_document, F.col("lookup") == F.col("answered_document"), "left")
        .join(fixed, "template", "left")
        .withColumn("result", F.coalesce("linked", "fixed"))
    )
    for c in RESULT_COLUMNS:
        joined = joined.withColumn(c, F.col(f"result.{c}"))
    return _finish(joined)


def _finish(joined: DataFrame) -> DataFrame:
    rejected = (
        F.when(F.col("rejection_reason") == "out_of_domain", OUT_OF_DOMAIN)
        .when(F.col("rejection_reason") == "unsupported_query", UNSUPPORTED)
        .when(F.col("rejection_reason") == "data_not_loaded", NOT_LOADED)
    )
    answered = ~F.col("rejected")
    return joined.select(
        "message_id",
        "template",
        "rejected",
        "rejection_reason",
        F.coalesce(rejected, "answer", F.lit(NO_ROWS)).alias("answer"),
        F.when(answered, F.coalesce("columns", F.array().cast("array<string>"))).alias("columns"),
        F.when(answered, F.coalesce("rows", F.lit("[]"))).alias("rows"),
        F.when(answered, F.coalesce("row_count", F.lit(0))).alias("row_count"),
        F.when(answered, F.coalesce("total_count", F.lit(0))).alias("total_count"),
        "highlights",
    )
