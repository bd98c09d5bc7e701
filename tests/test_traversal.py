import random

import pytest
from pyspark.sql import functions as F

from flowgraph.operators import traversal
from flowgraph.operators.ranking import top_n_per_group
from flowgraph.operators.registry import (
    CODES,
    GRANULAR_CODES,
    codes_for_ids,
    edge_type_dim,
    edge_type_listing,
    ids_for_codes,
    non_granular,
    relationship_options,
    resolve_codes,
    with_type_id,
)
from flowgraph.operators.traversal import id_frame, neighbors, reach, subgraph, with_degrees

from conftest import column

D, B, H = "DELIVERED_AS", "BILLED_AS", "HAS_ITEM"


def test_degrees_count_a_loop_twice(make_graph):
    nodes, edges = make_graph([("a", D, "b"), ("a", D, "a"), ("b", H, "c")], lone=["z"])
    got = {r["node_id"]: (r["in_degree"], r["out_degree"], r["total_degree"]) for r in with_degrees(nodes, edges).collect()}
    assert got == {"a": (1, 2, 3), "b": (1, 1, 2), "c": (1, 0, 1), "z": (0, 0, 0)}
    ids = nodes.where("node_id <> 'c'")
    detail = {r["node_id"]: (r["in_degree"], r["out_degree"], r["total_degree"]) for r in traversal.node_details(nodes, edges, ids).collect()}
    assert detail == {k: v for k, v in got.items() if k != "c"}


def test_degree_sums_equal_the_number_of_edges(spark):
    from flowgraph.queries import stored_graph

    nodes, edges = stored_graph(spark, "/root/testdata/sf0.001")
    total = with_degrees(nodes, edges).agg(F.sum("in_degree"), F.sum("out_degree")).first()
    assert total[0] == total[1] == edges.count()


def test_neighbors(spark, make_graph):
    nodes, edges = make_graph([("a", D, "b"), ("c", B, "a"), ("a", B, "a"), ("a", H, "d")], lone=["z"])
    a = id_frame(spark, ["a"])
    for direction, want in (
        ("out", {f"{D}:a->b", f"{B}:a->a", f"{H}:a->d"}),
        ("in", {f"{B}:c->a", f"{B}:a->a"}),
        ("both", {f"{D}:a->b", f"{B}:a->a", f"{B}:c->a", f"{H}:a->d"}),
    ):
        found_nodes, found = neighbors(nodes, edges, a, direction=direction)
        assert column(found, "edge_id") == sorted(want)
    assert column(neighbors(nodes, edges, a, include_granular=False)[0], "node_id") == ["a", "b", "c"]
    assert column(neighbors(nodes, edges, a, limit=1)[1], "edge_id") == [f"{B}:a->a"]
    # No edges: the centre alone; unknown node: nothing.
    assert column(neighbors(nodes, edges, id_frame(spark, ["z"]))[0], "node_id") == ["z"]
    assert neighbors(nodes, edges, id_frame(spark, ["nope"]))[0].count() == 0
    with pytest.raises(ValueError):
        neighbors(nodes, edges, a, limit=0)
    with pytest.raises(ValueError):
        neighbors(nodes, edges, a, direction="up")


def test_edge_type_selection(spark):
    assert resolve_codes() == resolve_codes([]) == CODES and len(CODES) == 9
    assert resolve_codes(include_granular=False) == [c for c in CODES if c not in GRANULAR_CODES]
    ids = ids_for_codes([H, D])
    assert codes_for_ids(ids) == [H, D]
    assert resolve_codes(ids, include_granular=False) == [D]
    assert resolve_codes(["00000000-0000-0000-0000-000000000000"]) == []
    assert resolve_codes(ids_for_codes([H]), include_granular=False) == []
    assert {r["id"] for r in edge_type_dim(spark).collect()} == set(ids_for_codes(CODES))


def test_unknown_codes_are_listed_but_not_walked(spark, make_graph):
    nodes, edges = make_graph([("a", "ODD", "b"), ("a", D, "c")])
    listed = {r["code"]: r for r in edge_type_listing(spark, edges).collect()}
    assert set(listed) == {"ODD", D}
    odd = listed["ODD"]
    assert (odd["displayName"], odd["description"], odd["group"], odd["isGranular"]) == ("ODD", "Relationship type ODD", "other", False)
    assert listed[D]["displayName"] == "DELIVERED_AS — Sales order delivered as delivery"
    assert odd["id"] == with_type_id(edges).where("edge_type = 'ODD'").first()["type_id"]
    assert column(reach(edges, id_frame(spark, ["a"]), 2, CODES), "node_id") == ["a", "c"]
    assert column(non_granular(edges), "edge_type") == [D, "ODD"]
    assert edge_type_listing(spark).count() == 9
    assert edge_type_listing(spark, edges.limit(0)).count() == 0
    options = relationship_options(edge_type_listing(spark, edges)).collect()
    assert [r["label"] for r in options] == ["All relationships", listed[D]["displayName"], "ODD"]


def walk(edges, seeds, hops):
    depth = {s: 0 for s in seeds}
    for d in range(hops):
        for s, _, t in edges:
            for x, y in ((s, t), (t, s)):
                if depth.get(x) == d and y not in depth:
                    depth[y] = d + 1
    return depth


@pytest.mark.parametrize("seed", [1, 2])
def test_reach_equals_a_plain_walk(spark, make_graph, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(60)]
    edges = sorted({(rng.choice(names), rng.choice([D, B, H]), rng.choice(names)) for _ in range(55)})
    _, frame = make_graph(edges)
    seeds = names[:3]
    before = set()
    for hops in (0, 1, 3, 6):
        got = {r["node_id"]: r["depth"] for r in reach(frame, id_frame(spark, seeds), hops, CODES).collect()}
        assert got == walk(edges, seeds, hops)
        assert before <= set(got)
        before = set(got)


def test_subgraph_has_all_edges_among_the_reached(spark, make_graph):
    nodes, edges = make_graph([("a", D, "b"), ("b", B, "c"), ("a", H, "c"), ("c", D, "d")])
    found_nodes, found = subgraph(nodes, edges, id_frame(spark, ["a"]), max_hops=1)
    assert column(found_nodes, "node_id") == ["a", "b", "c"]
    assert column(found, "edge_id") == sorted([f"{D}:a->b", f"{B}:b->c", f"{H}:a->c"])
    found_nodes, found = subgraph(nodes, edges, id_frame(spark, ["a"]), max_hops=0)
    assert column(found_nodes, "node_id") == ["a"] and found.count() == 0


def test_subgraph_caps(spark, make_graph):
    nodes, edges = make_graph([("a", D, f"b{i}") for i in range(6)] + [("b0", B, "c")])
    a = id_frame(spark, ["a"])
    found_nodes, found = subgraph(nodes, edges, a, max_hops=2, max_nodes=3)
    assert column(found_nodes, "node_id") == ["a", "b0", "c"]  # BILLED_AS sorts first
    assert column(found, "edge_id") == [f"{B}:b0->c", f"{D}:a->b0"]
    found_nodes, found = subgraph(nodes, edges, a, max_hops=2, max_edges=2)
    assert column(found, "edge_id") == [f"{B}:b0->c", f"{D}:a->b0"]
    # Seeds are kept even when they are more than the cap; a seed outside the graph gives no row.
    many = id_frame(spark, ["b1", "b2", "b3", "nope"])
    found_nodes, found = subgraph(nodes, edges, many, max_hops=2, max_nodes=2)
    assert column(found_nodes, "node_id") == ["b1", "b2", "b3"] and found.count() == 0
    with pytest.raises(ValueError):
        subgraph(nodes, edges, a, max_hops=7)
    with pytest.raises(ValueError):
        subgraph(nodes, edges, a, max_nodes=5001)


def test_no_edge_type_gives_the_seeds_only(spark, make_graph):
    nodes, edges = make_graph([("a", D, "b"), ("c", D, "b")])
    request = dict(edge_type_ids=ids_for_codes([H]), include_granular=False, max_nodes=2)
    found_nodes, found = subgraph(nodes, edges, id_frame(spark, ["c", "b", "a"]), **request)
    assert column(found_nodes, "node_id") == ["b", "c"] and found.count() == 0


def test_top_n_is_exact_above_the_group_limit_threshold(spark):
    rows = spark.range(20000).selectExpr("CASE WHEN id < 15000 THEN 'hot' ELSE concat('k', id % 7) END AS g", "id")
    got = top_n_per_group(rows, ["g"], [F.desc("id")], 1200)
    want = rows.selectExpr("*", "row_number() over (partition by g order by id desc) AS r").where("r <= 1200")
    assert got.select("g", "id").exceptAll(want.select("g", "id")).count() == 0
    assert got.count() == want.count()


def test_a_hub_is_not_shuffled_raw(make_graph):
    _, edges = make_graph([("a", D, "b")])
    plan = traversal.degrees(edges)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_sum" in plan
