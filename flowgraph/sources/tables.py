"""Stored raw and graph tables: create, load, rebuild, extend, look up."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.projection import build_edges, build_nodes
from ..session import as_stored
from ..specs import EDGE_SCHEMA, NODE_SCHEMA, RAW_TABLES, raw_schema
from .jsonl import PATTERN, read_raw_table, wanted_tables
from .links import LINK_TABLES

# Partition columns of the graph tables: every query selects by type.
PARTITIONED_BY = {"graph_nodes": "node_type", "graph_edges": "edge_type"}

AUDIT_SCHEMA = "table string, status string, inserted bigint, rows_in_table bigint, malformed bigint"
#: Lines that a permissive load could not read, by the raw table whose folder they lie in.
QUARANTINE = T.StructType([T.StructField("payload", T.StringType()), T.StructField("raw_table", T.StringType())])


def ensure_table(
    spark: SparkSession, name: str, schema: T.StructType, partition_by: str | None = None, lookup: tuple[str, ...] = ()
) -> None:
    """Create the table, empty, if it is missing; ``lookup`` columns get bloom filters in every file it ever has."""
    if spark.catalog.tableExists(name):
        return
    writer = as_stored(spark.createDataFrame([], schema).write.format("parquet"), lookup)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.saveAsTable(name)


def ensure_databases(spark: SparkSession, raw_db: str = "raw", graph_db: str = "graph") -> None:
    """All raw and graph tables exist afterwards."""
    for db in (raw_db, graph_db):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{db}`")
    for table in RAW_TABLES:
        ensure_table(spark, f"{raw_db}.{table}", raw_schema(table))
    ensure_graph(spark, graph_db)


# Columns that lookups ask for; graph rows are stored in the order of the first.
LOOKUP = {"graph_nodes": ("node_id", "node_key"), "graph_edges": ("src_node_id", "dst_node_id")}


def ensure_graph(spark: SparkSession, graph_db: str) -> None:
    """Both graph tables exist afterwards."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{graph_db}`")
    for table, schema in (("graph_nodes", NODE_SCHEMA), ("graph_edges", EDGE_SCHEMA)):
        ensure_table(spark, f"{graph_db}.{table}", schema, PARTITIONED_BY[table], LOOKUP[table])


def in_lookup_order(rows: DataFrame, table: str) -> DataFrame:
    """Rows of a file by type and first lookup column, so that page statistics leave a lookup few pages to read.

    No exchange is made for it: ids are random, so a range for each file would
    only save the bloom filters' reading.
    """
    return rows.sortWithinPartitions(PARTITIONED_BY[table], LOOKUP[table][0])


def write_table(
    rows: DataFrame, name: str, truncate: bool, partition_by: str | None = None, lookup: tuple[str, ...] = ()
) -> int:
    """Write to a table, replacing or appending; returns the rows written, counted on the way."""
    seen = Observation()
    counted = rows.observe(seen, F.count(F.lit(1)).alias("inserted"))
    spark = rows.sparkSession
    if not truncate and spark.catalog.tableExists(name):
        counted.select(*spark.table(name).columns).write.insertInto(name, overwrite=False)
    else:
        writer = as_stored(counted.write.format("parquet").mode("overwrite"), lookup)
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.saveAsTable(name)
    return seen.get["inserted"]


#: Property of a raw table that changes whenever its rows are replaced.
GENERATION = "flowgraph.generation"


def generation(spark: SparkSession, name: str) -> str:
    """Which filling of a raw table its rows belong to; appended rows belong to the last one."""
    found = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    return found.get(GENERATION, "")


def write_raw(rows: DataFrame, name: str, truncate: bool) -> int:
    """Write rows with ids from 0 to a raw table; appended ones go on after the highest id stored. Returns their number."""
    spark = rows.sparkSession
    if not truncate and spark.catalog.tableExists(name):
        top = spark.table(name).agg(F.max("row_id")).first()[0]
        rows = rows.withColumn("row_id", F.col("row_id") + F.lit(-1 if top is None else top) + 1)
        return write_table(rows, name, truncate)
    inserted = write_table(rows, name, truncate)
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('{GENERATION}' = '{uuid.uuid4().hex}')")
    return inserted


def load_raw(
    spark: SparkSession,
    dataset_dir: str,
    only: Iterable[str] | None = None,
    truncate: bool = True,
    raw_db: str = "raw",
    pattern: str = PATTERN,
    mode: str = "FAILFAST",
) -> DataFrame:
    """Load JSON-lines folders into the raw tables; returns the load audit.

    With ``mode`` PERMISSIVE malformed lines go to the table ``quarantine``
    (their text, and the raw table whose folder they lie in); a load that
    truncates a raw table replaces its lines there too. They are counted in
    the pass that loads the good lines; the folder is read again only if
    there are any.

    Appending adds all rows again (raw tables have no unique key); row ids go
    on after the highest one stored.
    """
    wanted = wanted_tables(spark, dataset_dir, only)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{raw_db}`")
    audit = []
    for table in RAW_TABLES:
        if table not in wanted:
            continue
        name = f"{raw_db}.{table}"
        ensure_table(spark, name, raw_schema(table))
        rows = read_raw_table(spark, dataset_dir, table, mode, pattern)
        if rows is None:
            audit.append((table, "skip", 0, spark.table(name).count(), 0))
            continue
        malformed = 0
        if "_corrupt_record" in rows.columns:
            seen, bad = Observation(), F.col("_corrupt_record").isNotNull()
            good = rows.observe(seen, F.count_if(bad).alias("malformed")).where(~bad)
            inserted = write_raw(good.drop("_corrupt_record"), name, truncate)
            malformed = seen.get["malformed"]
            _quarantine(rows.where(bad), table, raw_db, truncate, malformed)
        else:
            inserted = write_raw(rows, name, truncate)
        audit.append((table, "ok", inserted, spark.table(name).count(), malformed))
    return spark.createDataFrame(audit, AUDIT_SCHEMA)


def _quarantine(rows: DataFrame, table: str, raw_db: str, truncate: bool, malformed: int) -> None:
    spark, name = rows.sparkSession, f"{raw_db}.quarantine"
    ensure_table(spark, name, QUARANTINE, "raw_table")
    if truncate:
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION (raw_table = '{table}')")
    if malformed:
        rows.select("payload", F.lit(table).alias("raw_table")).write.insertInto(name)


def raw_tables(spark: SparkSession, raw_db: str = "raw") -> dict[str, DataFrame]:
    return {t: spark.table(f"{raw_db}.{t}") for t in RAW_TABLES}


def graph_tables(spark: SparkSession, graph_db: str = "graph") -> tuple[DataFrame, DataFrame]:
    """Stored nodes and edges in their declared column order."""
    return (
        spark.table(f"{graph_db}.graph_nodes").select(*NODE_SCHEMA.fieldNames()),
        spark.table(f"{graph_db}.graph_edges").select(*EDGE_SCHEMA.fieldNames()),
    )


#: Tables beside the graph in which ``extend_graph`` keeps what it needs of rows it won't read again.
STATE_TABLES = ("graph_marks", "graph_pending", "graph_descriptions")


def write_graph(
    spark: SparkSession, raw: Mapping[str, DataFrame], graph_db: str = "graph", truncate: bool = True
) -> dict[str, int]:
    """Build the graph into the stored tables: a rebuild, or the addition of what is new.

    Nodes are written first; the edge rules then read the stored nodes.  Rows
    are stored by type and id, with bloom filters, for lookups.  ``raw`` may
    be any tables, so all of their rows are read; ``extend_graph`` reads only
    what was appended to stored raw tables.
    """
    ensure_graph(spark, graph_db)
    nodes_name, edges_name = f"{graph_db}.graph_nodes", f"{graph_db}.graph_edges"
    for state in (*STATE_TABLES, *LINK_TABLES):  # what was kept beside the graph doesn't hold any more
        spark.sql(f"DROP TABLE IF EXISTS {graph_db}.{state}")
    nodes = build_nodes(raw, known=None if truncate else spark.table(nodes_name))
    counts = {"nodes": _store(nodes, "graph_nodes", graph_db, truncate)}
    edges = build_edges(raw, nodes=spark.table(nodes_name), known=None if truncate else spark.table(edges_name))
    return counts | {"edges": _store(edges, "graph_edges", graph_db, truncate)}


def _store(rows: DataFrame, table: str, graph_db: str, truncate: bool) -> int:
    name = f"{graph_db}.{table}"
    n = write_table(in_lookup_order(rows, table), name, truncate, PARTITIONED_BY[table], LOOKUP[table])
    rows.sparkSession.catalog.refreshTable(name)
    return n


def store_graph(nodes: DataFrame, edges: DataFrame, graph_db: str = "graph") -> dict[str, int]:
    """Make the stored tables from a graph at hand."""
    ensure_graph(nodes.sparkSession, graph_db)
    return {"nodes": _store(nodes, "graph_nodes", graph_db, True), "edges": _store(edges, "graph_edges", graph_db, True)}
