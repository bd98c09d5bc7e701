"""Graph queries: lookups, degrees, neighbours, k-hop subgraphs.

Graph inputs are the node table ``(node_id, node_key, node_type, label,
attrs, ...)`` and the edge table ``(edge_id, edge_key, src_node_id,
dst_node_id, edge_type, evidence)``.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import name_id
from ..session import counted, materialise
from .components import component_labels
from .ranking import top_n_per_group
from .registry import resolve_codes, with_type_id

if TYPE_CHECKING:
    from ..sources.links import Links

# Request defaults and upper bounds.
NEIGHBOR_LIMIT, NEIGHBOR_LIMIT_MAX = 200, 5000
MAX_HOPS, MAX_HOPS_MAX = 2, 6
MAX_NODES, MAX_NODES_MAX = 500, 5000
MAX_EDGES, MAX_EDGES_MAX = 2000, 20000

NODE_VIEW = ["node_id", "node_key", "node_type", "label", "attrs"]


def _check(name: str, value: int, low: int, high: int) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}, got {value}")


#: A request names its ids in a list; a table of ids may have any size.
Ids = DataFrame | list[str] | tuple[str, ...]


def id_frame(spark: SparkSession, node_ids: Iterable[str]) -> DataFrame:
    """A request's list of node ids as a table, with the position of the first occurrence.

    It is made of literals, so Catalyst knows how small it is and sends it to the other side of a join.
    """
    ids = list(dict.fromkeys(str(i) for i in node_ids))
    if not ids:
        return spark.createDataFrame([], "node_id string, pos int")
    listed = F.posexplode(F.array(*[F.lit(i) for i in ids])).alias("pos", "node_id")
    return spark.sql("SELECT 1").select(listed).select("node_id", "pos")


def _table(spark: SparkSession, ids: Ids) -> DataFrame:
    return ids if isinstance(ids, DataFrame) else id_frame(spark, ids)


# --------------------------------------------------------------------------- lookups


def nodes_by_ids(nodes: DataFrame, ids: Ids) -> DataFrame:
    """The nodes whose id is in ``ids``; ids without a node give no row.

    A list becomes a filter of the scan (bloom filters and the order of stored nodes spare most of it); a table, a join.
    """
    if not isinstance(ids, DataFrame):
        return nodes.where(F.col("node_id").isin([str(i) for i in ids]))
    return nodes.join(ids.select("node_id"), "node_id", "left_semi")


def node_id_by_key(nodes: DataFrame, keys: DataFrame | list[str]) -> DataFrame:
    """``(node_key, node_id)`` of the keys that exist; for a list the scan is filtered by the ids, functions of the keys."""
    if not isinstance(keys, DataFrame):
        found = nodes.where(F.col("node_id").isin([name_id(k) for k in keys]) & F.col("node_key").isin(list(keys)))
        return found.select("node_key", "node_id")
    wanted = keys.select("node_key")
    return nodes.join(wanted, "node_key", "left_semi").select("node_key", "node_id")


def degrees(edges: DataFrame) -> DataFrame:
    """In, out and total degree of every node that has an edge; a self-loop counts in both.

    One pass: each edge gives two partial counts that combine on the map side,
    so hubs cost one row per task.
    """
    ends = edges.select(
        F.expr(
            "inline(array(named_struct('node_id', src_node_id, 'i', 0L, 'o', 1L),"
            " named_struct('node_id', dst_node_id, 'i', 1L, 'o', 0L)))"
        )
    )
    return ends.groupBy("node_id").agg(
        F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count("*").alias("total_degree")
    )


def with_degrees(nodes: DataFrame, edges: DataFrame, links: Links | None = None) -> DataFrame:
    """Nodes with their degrees, 0 where there is no edge.  All edge types count; kept ``links`` have them counted."""
    counted = degrees(edges) if links is None else links.degrees
    return nodes.join(counted, "node_id", "left").fillna(0, ["in_degree", "out_degree", "total_degree"])


def node_details(nodes: DataFrame, edges: DataFrame, ids: Ids, links: Links | None = None) -> DataFrame:
    """Nodes by id with degrees, counted over the edges of these nodes only, or looked up in kept ``links``."""
    wanted = nodes_by_ids(nodes, ids)
    if links is not None:
        return with_degrees(wanted, edges, replace(links, degrees=nodes_by_ids(links.degrees, ids)))
    touching = incident_edges(edges, ids, "both")
    counts = touching.groupBy("seed_id").agg(
        F.expr("count_if(dst_node_id = seed_id)").alias("in_degree"),
        F.expr("count_if(src_node_id = seed_id)").alias("out_degree"),
    )
    joined = wanted.join(counts, F.col("node_id") == F.col("seed_id"), "left").drop("seed_id")
    return joined.fillna(0, ["in_degree", "out_degree"]).withColumn(
        "total_degree", F.col("in_degree") + F.col("out_degree")
    )


# --------------------------------------------------------------------------- adjacency


def adjacency(edges: DataFrame) -> DataFrame:
    """Undirected view, two rows per edge: ``(node_id, nbr_id)``.

    With it an expansion step is one equi-join instead of a join on either
    end, and one scan of the edges instead of two.
    """
    return edges.select(
        F.expr(
            "inline(array(named_struct('node_id', src_node_id, 'nbr_id', dst_node_id),"
            " named_struct('node_id', dst_node_id, 'nbr_id', src_node_id)))"
        )
    )


def incident_edges(edges: DataFrame, seeds: Ids, direction: str) -> DataFrame:
    """Edges at each seed (``node_id``, or ``seed_id`` if all differ) in the given direction, in one scan; a self-loop once.

    A list of ids becomes a filter of the scan on the ends, and no edge is exchanged.
    """
    ends = {
        "out": "src_node_id",
        "in": "dst_node_id",
        "both": "explode(array_distinct(array(src_node_id, dst_node_id)))",
    }
    if direction not in ends:
        raise ValueError(f"direction must be out, in or both, got {direction!r}")
    if isinstance(seeds, DataFrame):
        wanted = seeds
        if "seed_id" not in seeds.columns:
            # An exchange of the few ids by itself: right above an aggregate, AQE could not split a hub's partition.
            wanted = seeds.select(F.col("node_id").alias("seed_id")).distinct().hint("rebalance")
        return edges.selectExpr("*", f"{ends[direction]} AS seed_id").join(wanted, "seed_id").select("seed_id", *edges.columns)
    ids = [str(i) for i in seeds]
    out, into = F.col("src_node_id").isin(ids), F.col("dst_node_id").isin(ids)
    touching = edges.where({"out": out, "in": into, "both": out | into}[direction])
    found = touching.selectExpr("*", f"{ends[direction]} AS seed_id").where(F.col("seed_id").isin(ids))
    return found.select("seed_id", *edges.columns)


def neighbor_edges(
    edges: DataFrame,
    seeds: Ids,
    direction: str = "both",
    edge_type_ids: Iterable[str] | None = None,
    include_granular: bool = True,
    limit: int | None = None,
) -> DataFrame:
    """The edges at each seed node: ``seed_id`` + edge columns + ``type_id``.

    All of them, or with a ``limit`` (a request's feature; ``NEIGHBOR_LIMIT`` is the usual one) the first by key.
    """
    if limit is not None:
        _check("limit", limit, 1, NEIGHBOR_LIMIT_MAX)
    codes = resolve_codes(edge_type_ids, include_granular)
    found = incident_edges(edges.where(F.col("edge_type").isin(codes)), seeds, direction)
    if limit is not None:
        found = top_n_per_group(found, ["seed_id"], [F.col("edge_key")], limit).drop("rank")
    return with_type_id(found)


def as_payload(nodes: DataFrame) -> DataFrame:
    """Payload nodes: degrees are 0 there, as in the requests this model answers; ``node_details`` has the real ones."""
    return nodes.withColumns({c: F.lit(0) for c in ("in_degree", "out_degree", "total_degree")})


def payload_nodes(nodes: DataFrame, edges: DataFrame, always: Ids | None = None) -> DataFrame:
    """The nodes at the ends of ``edges`` and those of ``always``, as payload."""
    ids = edges.select(F.expr("explode(array(src_node_id, dst_node_id)) AS node_id"))
    if always is not None:
        ids = ids.unionByName(_table(nodes.sparkSession, always).select("node_id"))
    return as_payload(nodes_by_ids(nodes, ids.distinct()))


def neighbors(nodes: DataFrame, edges: DataFrame, seeds: Ids, **request) -> tuple[DataFrame, DataFrame]:
    """One-hop payload: nodes (the seeds too, even without edges) and edges."""
    found = neighbor_edges(edges, seeds, **request)
    return payload_nodes(nodes, found, seeds), found


# --------------------------------------------------------------------------- k hops


def _levels(
    edges: DataFrame, seeds: DataFrame, max_hops: int | None, codes: list[str], links: Links | None = None
) -> list[DataFrame]:
    """The written levels of a breadth-first walk; the first holds the different seeds."""
    if max_hops is not None and max_hops < 0:
        raise ValueError(f"max_hops must not be negative, got {max_hops}")
    pairs = adjacency(edges.where(F.col("edge_type").isin(codes)))
    levels = [materialise(seeds.select("node_id").where("node_id IS NOT NULL").distinct(), "level-0")]
    while max_hops is None or len(levels) <= max_hops:
        if links is None:
            found = pairs.join(levels[-1], "node_id", "left_semi").select(F.col("nbr_id").alias("node_id"))
        else:
            found = links.neighbours(levels[-1], codes)
        found = found.distinct()
        for earlier in levels[-2:]:
            found = found.join(earlier, "node_id", "left_anti")
        level, n = counted(found, f"level-{len(levels)}")
        if not n:
            break
        levels.append(level)
    return levels


def _reached(levels: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [lv.withColumn("depth", F.lit(d)) for d, lv in enumerate(levels)])


def reach(
    edges: DataFrame, seeds: DataFrame, max_hops: int | None, codes: list[str], links: Links | None = None
) -> DataFrame:
    """``(node_id, depth)``: all nodes within ``max_hops`` undirected steps of any seed; None goes on to the end.

    Breadth first, one written level per step.  In an undirected graph the
    neighbours of level d lie on d-1, d or d+1, so a step only has to leave
    out its two last levels, not everything visited.  Levels are parquet
    tables of known size: small ones are broadcast to the edges by Catalyst,
    large ones join by shuffle, where AQE splits the partition of a hub.
    With the graph's kept ``links`` a step reads the adjacency in its buckets;
    without them it makes one of the edges.
    The walk runs when this is called, one job per step.
    """
    return _reached(_levels(edges, seeds, max_hops, codes, links))


def connected(edges: DataFrame, seeds: DataFrame, codes: list[str]) -> DataFrame:
    """``(node_id)``: all that hangs together with any seed, the seeds too, however many steps away.

    By component labels of the allowed edges, in a number of jobs that grows with the logarithm of the number of
    nodes; a walk by steps would take a job for each step.
    """
    seeds = materialise(seeds.select("node_id").where("node_id IS NOT NULL").distinct(), "seeds")
    labels = materialise(component_labels(edges.where(F.col("edge_type").isin(codes))), "components")
    wanted = labels.join(seeds, "node_id", "left_semi").select("component").distinct()
    found = labels.join(wanted.hint("rebalance"), "component", "left_semi").select("node_id")
    return found.unionByName(seeds.join(labels, "node_id", "left_anti").select("node_id"))


def induced_edges(edges: DataFrame, reached: DataFrame, codes: list[str]) -> DataFrame:
    """All edges of the allowed types with both ends among the reached nodes, walked or not."""
    ids = reached.select("node_id")
    return (
        edges.where(F.col("edge_type").isin(codes))
        .join(ids.withColumnRenamed("node_id", "src_node_id"), "src_node_id", "left_semi")
        .join(ids.withColumnRenamed("node_id", "dst_node_id"), "dst_node_id", "left_semi")
        .select(*edges.columns)
    )


def cap_subgraph(edges: DataFrame, seeds: DataFrame, max_nodes: int, max_edges: int) -> tuple[DataFrame, DataFrame]:
    """Apply a request's caps: the first ``max_edges`` edges by key, then nodes up to ``max_nodes``.

    Seeds always stay; further nodes are taken by first appearance in the
    capped edges, source before target.  Edges with a dropped end go.
    The capped edges are written once; all that follows handles these at most
    ``MAX_EDGES_MAX`` rows.
    ``seeds`` are different ids, stored: they are read three times.
    Returns ``(ids, edges)``; the ids are stored too.
    """
    _check("max_nodes", max_nodes, 1, MAX_NODES_MAX)
    _check("max_edges", max_edges, 1, MAX_EDGES_MAX)
    capped = materialise(edges.orderBy("edge_key").limit(max_edges), "capped-edges")
    ends = capped.selectExpr(
        "edge_key", "posexplode(array(src_node_id, dst_node_id)) AS (side, node_id)"
    )
    order = F.struct("edge_key", "side")
    seed_ids = seeds.select("node_id")
    room = max(0, max_nodes - seed_ids.count())
    others = (
        ends.groupBy("node_id")
        .agg(F.min(order).alias("first_seen"))
        .join(seed_ids, "node_id", "left_anti")
        .orderBy("first_seen")
        .limit(room)
        .select("node_id")
    )
    ids = materialise(seed_ids.unionByName(others), "payload-ids")
    kept = (
        capped.join(ids.withColumnRenamed("node_id", "src_node_id"), "src_node_id", "left_semi")
        .join(ids.withColumnRenamed("node_id", "dst_node_id"), "dst_node_id", "left_semi")
        .select(*edges.columns)
    )
    return ids, kept


def subgraph(
    nodes: DataFrame,
    edges: DataFrame,
    seeds: Ids,
    max_hops: int = MAX_HOPS,
    edge_type_ids: Iterable[str] | None = None,
    include_granular: bool = True,
    max_nodes: int = MAX_NODES,
    max_edges: int = MAX_EDGES,
    links: Links | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The capped k-hop payload around a request's seeds: nodes and edges (with ``type_id``).

    Seeds are never dropped, except that a selection of no known edge type
    gives the first ``max_nodes`` seeds alone.
    """
    _check("max_hops", max_hops, 0, MAX_HOPS_MAX)
    _check("max_nodes", max_nodes, 1, MAX_NODES_MAX)
    _check("max_edges", max_edges, 1, MAX_EDGES_MAX)
    codes = resolve_codes(edge_type_ids, include_granular)
    seeds = _table(nodes.sparkSession, seeds)
    if not codes:
        order = "pos" if "pos" in seeds.columns else "node_id"
        return as_payload(nodes_by_ids(nodes, seeds.orderBy(order).limit(max_nodes))), with_type_id(edges.limit(0))
    levels = _levels(edges, seeds, max_hops, codes, links)
    ids, kept = cap_subgraph(induced_edges(edges, _reached(levels), codes), levels[0], max_nodes, max_edges)
    return as_payload(nodes_by_ids(nodes, ids)), with_type_id(kept)


def full_subgraph(
    nodes: DataFrame,
    edges: DataFrame,
    seeds: Ids,
    max_hops: int | None = MAX_HOPS,
    edge_type_ids: Iterable[str] | None = None,
    include_granular: bool = True,
    links: Links | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The k-hop subgraph without caps, for seed sets of any size; ``max_hops`` None takes all that is connected."""
    codes = resolve_codes(edge_type_ids, include_granular)
    seeds = _table(nodes.sparkSession, seeds)
    reached = connected(edges, seeds, codes) if max_hops is None else reach(edges, seeds, max_hops, codes, links)
    return as_payload(nodes_by_ids(nodes, reached)), with_type_id(induced_edges(edges, reached, codes))


def focus_subgraph(nodes: DataFrame, edges: DataFrame, focus: Ids, **request) -> tuple[DataFrame, DataFrame]:
    """Expansion around a focused node with the preset 3 hops, 300 nodes, 800 edges."""
    return subgraph(nodes, edges, focus, max_hops=3, max_nodes=300, max_edges=800, **request)
