"""Tables kept beside the stored edges: degrees, and a two-way adjacency that a hop reads without an exchange.

``graph_adjacency`` has two rows for each edge, bucketed by ``(node_id, sub)``. A node with many links has them spread
over several values of ``sub``, and so over several buckets; ``graph_hubs`` says how many. ``graph_degrees`` has counts
that add up by node. All three grow by the new edges alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import packed_id, unpacked_id
from ..operators.traversal import degrees
from ..session import as_stored, materialise

#: Links of a node that share a value of ``sub``, and links of a bucket.
HUB_LINKS, BUCKET_LINKS = 100_000, 2_000_000
LINK_TABLES = ("graph_degrees", "graph_hubs", "graph_adjacency")


@dataclass(frozen=True)
class Links:
    """The kept tables of a graph, as the traversal reads them."""

    degrees: DataFrame  #: ``node_id, in_degree, out_degree, total_degree`` for each node with an edge
    hubs: DataFrame  #: ``node_id, subs`` of nodes with links in more than one sub-bucket
    adjacency: DataFrame  #: ``node_id, sub, nbr_id, edge_type, outgoing``

    def neighbours(self, frontier: DataFrame, codes: list[str]) -> DataFrame:
        """``(node_id)`` of the neighbours of ``frontier``, repeated as often as they occur.

        Only the frontier is exchanged (or broadcast, if Catalyst knows it to be small), a row for each sub-bucket of
        a hub; the adjacency is read in its buckets.
        """
        spread = frontier.select("node_id").join(self.hubs, "node_id", "left")
        spread = spread.selectExpr("node_id", "explode(sequence(0, coalesce(subs, 1) - 1)) AS sub")
        links = self.adjacency.where(F.col("edge_type").isin(codes))
        return links.join(spread, ["node_id", "sub"], "left_semi").select(F.col("nbr_id").alias("node_id"))


def link_tables(spark: SparkSession, db: str) -> Links:
    """The kept tables; counts of several writes are added up."""
    counted = spark.table(f"{db}.graph_degrees").groupBy("node_id")
    total = counted.agg(*[F.sum(c).alias(c) for c in ("in_degree", "out_degree", "total_degree")])
    hubs = spark.table(f"{db}.graph_hubs").groupBy("node_id").agg(F.max("subs").alias("subs"))
    return Links(total, hubs, spark.table(f"{db}.graph_adjacency"))


def keep_links(edges: DataFrame, db: str, truncate: bool, hub_links: int = HUB_LINKS) -> None:
    """Make the tables from all ``edges``, or add new ones to them.

    A node's number of sub-buckets only rises; links that were written before stay in theirs, and every hop asks for
    all of a node's.
    """
    spark = edges.sparkSession
    at = lambda table: f"{db}.{table}"
    grown = not truncate and spark.catalog.tableExists(at("graph_degrees"))
    if not grown:
        for table in LINK_TABLES:
            spark.sql(f"DROP TABLE IF EXISTS {at(table)}")
        n = 2 * edges.count()
        total = _total_of_crowded(edges, n, hub_links)
    else:
        counts = materialise(degrees(edges), "degrees")
        total = counts.select("node_id", "total_degree")
        before = spark.table(at("graph_degrees")).select("node_id", "total_degree")
        total = total.unionByName(before.join(counts, "node_id", "left_semi"))
        total = total.groupBy("node_id").agg(F.sum("total_degree").alias("total_degree"))
    hubs = total.where(F.col("total_degree") > hub_links)
    hubs = materialise(hubs.select("node_id", F.ceil(F.col("total_degree") / hub_links).cast("int").alias("subs")), "hubs")
    rows = edges.select(
        F.expr(
            "inline(array(named_struct('node_id', src_node_id, 'nbr_id', dst_node_id, 'edge_type', edge_type, 'outgoing', true),"
            " named_struct('node_id', dst_node_id, 'nbr_id', src_node_id, 'edge_type', edge_type, 'outgoing', false)))"
        )
    )
    rows = rows.join(hubs, "node_id", "left").select(
        "node_id", F.expr("CAST(pmod(xxhash64(nbr_id), coalesce(subs, 1)) AS INT) AS sub"), "nbr_id", "edge_type", "outgoing"
    )
    if grown:
        counts.write.insertInto(at("graph_degrees"))
        hubs.write.insertInto(at("graph_hubs"))
        rows.select(*spark.table(at("graph_adjacency")).columns).write.insertInto(at("graph_adjacency"))
        return
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // BUCKET_LINKS + 1)
    # Dealt out as the buckets are, each task writes one bucket and no file is small; ids cross the network as bytes.
    sent = rows.select(F.expr(packed_id("node_id")).alias("a"), "sub", F.expr(packed_id("nbr_id")).alias("b"), "edge_type", "outgoing")
    dealt = sent.repartition(buckets, F.expr(unpacked_id("a")), "sub").select(
        F.expr(unpacked_id("a")).alias("node_id"), "sub", F.expr(unpacked_id("b")).alias("nbr_id"), "edge_type", "outgoing"
    )
    writer = as_stored(dealt.write.format("parquet"))
    writer.bucketBy(buckets, "node_id", "sub").sortBy("node_id", "sub").saveAsTable(at("graph_adjacency"))
    as_stored(hubs.write.format("parquet")).saveAsTable(at("graph_hubs"))
    # Written last: links that grow are whole where there are degrees.
    as_stored(_count_links(spark.table(at("graph_adjacency"))).write.format("parquet")).saveAsTable(at("graph_degrees"))


def _count_links(adjacency: DataFrame) -> DataFrame:
    """The degrees by an adjacency's rows, in counts that add up by node: bucket by bucket, without an exchange."""
    counts = adjacency.groupBy("node_id", "sub").agg(
        F.count_if(~F.col("outgoing")).alias("in_degree"), F.count_if("outgoing").alias("out_degree"), F.count("*").alias("total_degree")
    )
    return counts.drop("sub")


def _total_of_crowded(edges: DataFrame, n_links: int, hub_links: int) -> DataFrame:
    """``(node_id, total_degree)`` of a few nodes, all hubs among them.

    Links are counted by cells of the ids' hashes, which combine on the map side to a row for each cell; only nodes of
    cells with more than ``hub_links`` links can be hubs, and these are counted by id.
    """
    cells = max(1 << 16, 16 * n_links // hub_links)  # a cell holds a sixteenth of that on average, or less
    ends = edges.select(F.expr("explode(array(src_node_id, dst_node_id)) AS node_id"))
    ends = ends.withColumn("cell", F.expr(f"CAST(pmod(xxhash64(node_id), {cells}L) AS INT)"))
    crowded = ends.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > hub_links).select("cell")
    crowded = materialise(crowded, "crowded")
    return ends.join(crowded, "cell", "left_semi").groupBy("node_id").agg(F.count("*").alias("total_degree"))
