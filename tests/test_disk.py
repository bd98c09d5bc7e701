"""What the queries leave on the disk: size of stored tables and of scratch files."""

import os
from pathlib import Path

import pytest

from flowgraph import queries
from flowgraph.functions.ids import packed_id, unpacked_id, uuid5
from flowgraph.operators import integrity, traversal
from flowgraph.session import materialise, scratch_dir
from flowgraph.sources.jsonl import read_raw
from flowgraph.sources.links import _count_links, keep_links, link_tables
from flowgraph.sources import tables
from flowgraph.sources.roles import ROLE_SQL, RoleTables

LINES = 3_000


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    """A small star schema of its own."""
    folder = tmp_path_factory.mktemp("star")
    day = "TIMESTAMP '1996-01-01' + make_interval(0, 0, 0, CAST(id % 900 AS INT))"
    made = {
        "orders": (LINES // 3, f"id AS o_orderkey, id % 97 AS o_custkey, IF(id % 2 = 0, 'F', 'O') AS o_orderstatus, id * 7.5D AS o_totalprice,"
                   f" {day} AS o_orderdate, elt(1 + id % 4, '1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW') AS o_orderpriority"),
        "lineitem": (LINES, f"id div 3 AS l_orderkey, id % 61 AS l_partkey, id % 7 AS l_suppkey, CAST(1 + id % 3 AS INT) AS l_linenumber,"
                     f" CAST(1 + id % 50 AS DOUBLE) AS l_quantity, id * 1.25D AS l_extendedprice, id % 10 / 100D AS l_discount, 0.01D AS l_tax,"
                     f" IF(id % 5 = 0, 'R', 'N') AS l_returnflag, IF(id % 2 = 0, 'F', 'O') AS l_linestatus, {day} AS l_shipdate"),
        "part": (61, "id AS p_partkey, concat('part ', id) AS p_name, 'Brand#1' AS p_brand, elt(1 + id % 3, 'LARGE', 'SMALL', 'PROMO') AS p_type,"
                 " CAST(id % 50 AS INT) AS p_size, 1D AS p_retailprice"),
        "customer": (97, "id AS c_custkey, concat('c', id) AS c_name, CAST(1 AS INT) AS c_nationkey, 1D AS c_acctbal, 'X' AS c_mktsegment"),
        "events": (200, f"id AS event_id, {day} AS ts, id % 97 AS user_id, IF(id % 2 = 0, 'purchase', 'view') AS event_type, 1D AS value, '{{}}' AS props"),
    }
    for table, (n, columns) in made.items():
        spark.sql(f"SELECT {columns} FROM range(0, {n}, 1, 2)").write.parquet(f"{folder}/{table}.parquet")
    return str(folder)


def _bytes(folder) -> int:
    return sum(f.stat().st_size for f in Path(folder).rglob("*") if f.is_file())


def _folders(spark) -> set[str]:
    return set(os.listdir(scratch_dir(spark)))


def test_json_lines_are_compressed_and_whole(spark, star, monkeypatch):
    """the text of a payload takes some ten times its compressed size."""
    monkeypatch.setattr(queries, "JSON_FILE_LINES", 400)
    raw = RoleTables(spark, star)
    folder = queries._json_lines(raw)
    loaded = read_raw(spark, folder, list(ROLE_SQL), pattern=queries.JSON_FILES)
    items = loaded["sales_order_items"]
    text = items.selectExpr("sum(octet_length(payload) + 1)").first()[0]
    assert _bytes(f"{folder}/sales_order_items") * 4 < text
    assert items.inputFiles() and len(items.inputFiles()) >= LINES // 400
    columns = raw["sales_order_items"].columns
    assert items.select(columns).exceptAll(raw["sales_order_items"]).count() == 0
    assert {t: df.count() for t, df in loaded.items()} == {t: raw[t].count() for t in ROLE_SQL}


def test_audits_of_loaded_lines_leave_no_lines(spark, star):
    """the lines are gone when the audit is there, so two audits in a row don't add up."""
    before = _folders(spark)
    found = {name: queries.QUERIES[name](spark, star) for name in ("raw_row_ids", "payload_null_audit", "load_audit")}
    assert sum(_bytes(Path(scratch_dir(spark)) / f) for f in _folders(spark) - before) < 50_000
    raw = RoleTables(spark, star)
    assert {r["table"]: (r["n"], r["n_ids"], r["from_zero"]) for r in found["raw_row_ids"].collect()} == {
        t: (raw[t].count(), raw[t].count(), True) for t in ROLE_SQL
    }
    assert {(r["table"], r["n_null"]) for r in found["payload_null_audit"].collect()} == {(t, 0) for t in ROLE_SQL}
    assert found["load_audit"].count() == len(ROLE_SQL) * 2


def test_stored_ids_take_half_a_byte_a_digit(spark):
    """F1 to F24: an id of 36 characters has 122 random bits; snappy kept all 36 bytes, and 4 for the length."""
    rows = spark.range(0, 40_000, 1, 1).select(uuid5("concat('x', id)").alias("node_id"))
    stored = materialise(rows, "ids")
    assert stored.count() == 40_000 and stored.exceptAll(rows).count() == 0
    assert sum(os.path.getsize(f.removeprefix("file:").replace("///", "/")) for f in stored.inputFiles()) < 40_000 * 24


def test_packed_ids_come_back(spark):
    """Ids of any form, also those that look like packed ones."""
    ids = ["", "a", "x" * 16, "x" * 36, "\0" * 16, "\0", "caccffac-b24d-5a4c-8380-13dfbc68cc68", "CACCFFAC-B24D-5A4C-8380-13DFBC68CC68", "é", None]
    rows = spark.createDataFrame([(i,) for i in ids], "id string").selectExpr("id", f"{packed_id('id')} AS p").cache()
    assert [r["back"] for r in rows.selectExpr("id", f"{unpacked_id('p')} AS back").collect()] == ids
    assert rows.select("p").distinct().count() == len(ids)
    assert rows.where("octet_length(p) = 16").count() == 1


@pytest.fixture(scope="module")
def wide(spark):
    """Edges between ids of the usual form: 30,000 nodes, a hub, a loop, and ends of other forms."""
    ids = spark.range(0, 30_000, 1, 4).selectExpr(
        "id",
        "CASE WHEN id % 3 = 0 THEN 'hub' WHEN id = 7 THEN 'loop' WHEN id <> 8 THEN concat('a', id % 900) END AS a",
        "CASE WHEN id = 7 THEN 'loop' WHEN id <> 10 THEN concat('b', id) END AS b",
    )
    ids = ids.select("id", uuid5("a").alias("src_node_id"), uuid5("b").alias("dst_node_id"))
    rows = ids.selectExpr(
        "concat('e', id) AS edge_id", "concat('k', id) AS edge_key", "src_node_id", "IF(id = 11, 'plain', dst_node_id) AS dst_node_id",
        "'DELIVERED_AS' AS edge_type", "'{}' AS evidence",
    )
    return materialise(rows, "wide")


def test_degrees_come_from_the_buckets(spark, wide):
    """F11, node_degrees and others on kept links: no exchange of all ends, and rows as by one count of the edges."""
    spark.sql("CREATE DATABASE IF NOT EXISTS disk_links")
    keep_links(wide, "disk_links", truncate=True, hub_links=2_000)
    links = link_tables(spark, "disk_links")
    rows = lambda df: sorted(map(str, df.select("node_id", "in_degree", "out_degree", "total_degree").collect()))
    assert rows(links.degrees) == rows(traversal.degrees(wide))
    assert links.hubs.count() == 1 and links.hubs.first()["subs"] == 5
    plan = _count_links(spark.table("disk_links.graph_adjacency"))._jdf.queryExecution().executedPlan().toString()
    assert "graph_adjacency" in plan and "Exchange" not in plan
    pairs = lambda df: sorted(map(str, df.select("node_id", "nbr_id").collect()))
    assert pairs(links.adjacency) == pairs(traversal.adjacency(wide))
    spark.sql("DROP DATABASE disk_links CASCADE")


def test_dangling_edges_exchange_no_edges(spark, wide):
    """only different ids are exchanged to find the lost ends; edges without an end, or named twice, count too."""
    nodes = wide.selectExpr("explode(array(src_node_id, dst_node_id)) AS node_id").where("node_id IS NOT NULL").distinct()
    nodes = nodes.where("substring(node_id, 1, 2) NOT IN ('1a', '2b')")
    twice = wide.unionByName(wide.where("edge_key = 'k12'"))
    known = {r[0] for r in nodes.collect()}
    wanted = sorted(
        (r["edge_key"], side) for r in twice.collect() for side in ("src", "dst") if r[f"{side}_node_id"] not in known
    )
    found = integrity.dangling_edges(nodes, twice)
    assert sorted((r["edge_key"], r["missing"]) for r in found.collect()) == wanted and len(wanted) > 100
    assert found.columns == [*twice.columns, "missing"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


def test_an_extension_makes_ids_of_new_rows_only(spark, star, monkeypatch):
    """what is known is left out before ids and JSON are made; both were exchanged for every candidate."""
    raw, plans = RoleTables(spark, star), []
    own = tables._store
    monkeypatch.setattr(tables, "_store", lambda rows, *a: (plans.append(rows._jdf.queryExecution().optimizedPlan().toString()), own(rows, *a))[1])
    part = {t: df.where("sales_order % 3 = 0") if t == "sales_order_headers" else df for t, df in raw.items()}
    first = tables.write_graph(spark, part, "disk_graph")
    added = tables.write_graph(spark, raw, "disk_graph", truncate=False)
    again = tables.write_graph(spark, raw, "disk_graph", truncate=False)
    tables.write_graph(spark, raw, "disk_whole")
    nodes, edges = tables.graph_tables(spark, "disk_graph")
    whole = tables.graph_tables(spark, "disk_whole")
    assert added["nodes"] > 0 < added["edges"] and again == {"nodes": 0, "edges": 0}
    for mine, all_of, what in ((nodes, whole[0], "nodes"), (edges, whole[1], "edges")):
        assert mine.count() == all_of.count() == first[what] + added[what]
        assert mine.exceptAll(all_of).count() == 0
    assert len(plans) == 8
    for plan in plans[2:4]:
        assert "sha1" in plan and "sha1" not in _below_anti(plan)
    for db in ("disk_graph", "disk_whole"):
        spark.sql(f"DROP DATABASE {db} CASCADE")


def _below_anti(plan: str) -> str:
    """The lines of a plan that lie below a left anti join."""
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    below, top = [], None
    for line in plan.splitlines():
        if top is not None and depth(line) <= top:
            top = None
        if top is not None:
            below.append(line)
        elif "Join LeftAnti" in line:
            top = depth(line)
    assert below
    return "\n".join(below)
