"""Component labels, the kept adjacency and kept degrees."""

import random

import pytest
from conftest import column
from pyspark.sql import functions as F

from flowgraph.functions.ids import name_id
from flowgraph.operators import display, traversal
from flowgraph.operators.components import component_labels
from flowgraph.operators.registry import CODES
from flowgraph.sources.links import keep_links, link_tables

D, B = "DELIVERED_AS", "BILLED_AS"


@pytest.fixture
def db(spark, request):
    name = f"links_{abs(hash(request.node.name)) % 10**8}"
    spark.sql(f"CREATE DATABASE {name}")
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


def _plain(pairs):
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    return {x: find(x) for x in root}


def _same_parts(found, expected):
    assert set(found) == set(expected)
    parts = lambda labels: {frozenset(x for x in labels if labels[x] == v) for v in set(labels.values())}
    assert parts(found) == parts(expected)


@pytest.mark.parametrize("seed", range(3))
def test_labels_equal_union_find(make_graph, seed):
    pick = random.Random(seed)
    pairs = [(f"n{pick.randrange(60):02d}", f"n{pick.randrange(60):02d}") for _ in range(45)]
    pairs += [("loop", "loop"), ("u", "v"), ("v", "u"), ("u", "v")]
    _, edges = make_graph([(a, D, b) for a, b in pairs])
    found = {r["node_id"]: r["component"] for r in component_labels(edges).collect()}
    _same_parts(found, _plain(pairs))


def test_no_edges_no_labels(make_graph):
    _, edges = make_graph([("a", D, "b")])
    assert component_labels(edges.limit(0)).collect() == []
    with_null = edges.withColumn("dst_node_id", F.lit(None).cast("string"))
    assert component_labels(with_null).collect() == []


@pytest.mark.parametrize("name", [lambda i: f"n{i:04d}", lambda i: name_id(f"SalesOrder:{i}")])
def test_a_long_path_takes_few_rounds(make_graph, monkeypatch, name):
    from flowgraph.operators import components
    from flowgraph.operators import traversal as t

    written = []
    for module in (components, t):
        for f in ("materialise", "counted"):
            own = getattr(module, f)
            monkeypatch.setattr(module, f, lambda df, n, own=own, **k: (written.append(n), own(df, n, **k))[1])
    nodes, edges = make_graph([(name(i), D, name(i + 1)) for i in range(999)] + [("x", D, "y")])
    found = t.connected(edges, nodes.where(F.col("node_id") == name(500)), CODES)
    assert found.count() == 1000
    assert len(written) < 25, written


def test_connected_keeps_seeds_without_edges_and_selects_types(make_graph):
    nodes, edges = make_graph([("a", D, "b"), ("b", B, "c"), ("d", D, "e")], lone=["z"])
    seeds = nodes.where("node_id IN ('a', 'z')")
    assert column(traversal.connected(edges, seeds, [D]), "node_id") == ["a", "b", "z"]
    assert column(traversal.connected(edges, seeds, [D, B]), "node_id") == ["a", "b", "c", "z"]
    assert column(traversal.connected(edges, nodes.limit(0), CODES), "node_id") == []
    assert traversal.full_subgraph(nodes, edges, ["a"], None)[1].count() == 2


def _graph(make_graph):
    pick = random.Random(9)
    edges = [(f"n{pick.randrange(40):02d}", pick.choice([D, B]), f"n{pick.randrange(40):02d}") for _ in range(60)]
    edges += [("hub", D, f"m{i:03d}") for i in range(300)] + [("loop", D, "loop")]
    return make_graph(sorted(set(edges)), lone=["alone"])


def test_a_walk_by_the_kept_adjacency(spark, make_graph, db):
    nodes, edges = _graph(make_graph)
    keep_links(edges, db, truncate=True, hub_links=50)
    links = link_tables(spark, db)
    assert column(links.hubs, "node_id") == ["hub"] and links.hubs.first()["subs"] == 6
    for codes in (CODES, [D], [B]):
        for seeds in (nodes.where("node_id IN ('n01', 'hub')"), nodes.where("node_id = 'm007'"), nodes.where("node_id = 'alone'")):
            rows = lambda df: sorted(map(tuple, df.collect()))
            assert rows(traversal.reach(edges, seeds, 3, codes, links)) == rows(traversal.reach(edges, seeds, 3, codes))
    one, other = (traversal.subgraph(nodes, edges, ["hub"], 2, links=x)[1] for x in (links, None))
    assert column(one, "edge_id") == column(other, "edge_id")


def test_links_grow_with_new_edges(spark, make_graph, db):
    nodes, edges = _graph(make_graph)
    turn = F.expr("pmod(xxhash64(edge_id), 3)")
    for part in range(3):
        keep_links(edges.where(turn == part), db, truncate=not part, hub_links=50)
    links = link_tables(spark, db)
    rows = lambda df: sorted(map(tuple, df.collect()))
    counted = ["node_id", "in_degree", "out_degree", "total_degree"]
    assert rows(links.degrees.select(counted)) == rows(traversal.degrees(edges).select(counted))
    assert rows(traversal.reach(edges, nodes.where("node_id = 'hub'"), 2, CODES, links)) == rows(traversal.reach(edges, nodes.where("node_id = 'hub'"), 2, CODES))
    cards = lambda x: rows(display.node_cards(nodes, edges, x).select("node_id", "connections"))
    assert cards(links) == cards(None)
    details = lambda x: rows(traversal.node_details(nodes, edges, ["hub", "loop", "alone"], x).select(counted))
    assert details(links) == details(None)
    plan = display.node_cards(nodes, edges, links)._jdf.queryExecution().executedPlan().toString()
    assert "graph_degrees" in plan and "dst_node_id" not in plan


def test_a_hop_exchanges_the_frontier_only(spark, make_graph, db):
    nodes, edges = _graph(make_graph)
    keep_links(edges, db, truncate=True, hub_links=50)
    links = link_tables(spark, db)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        text = links.neighbours(nodes.select("node_id"), CODES)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    # From the scan of the adjacency up to its join there is no exchange.
    lines = text.splitlines()
    scan = next(i for i, x in enumerate(lines) if "graph_adjacency" in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    above, level = [], depth(lines[scan])
    for x in reversed(lines[:scan]):
        if depth(x) < level:
            above.append(x)
            level = depth(x)
    before_join = above[: next(i for i, x in enumerate(above) if "Join" in x)]
    assert before_join and not any("Exchange" in x for x in before_join), text
    # A hub's links lie in several buckets.
    assert links.adjacency.where("node_id = 'hub'").select(F.input_file_name()).distinct().count() > 1
