"""Wall time of the headline queries: prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all),
BENCH_WARM_DIR (default sf0.001 beside it; empty: none): every query runs there
once, untimed, so that a long-running session is measured and not its start.
Arguments: query names, or ``all``; ``--duckdb`` times the SQL oracles in DuckDB instead.  Each query runs to its last row into a
sink that keeps nothing; ``graph_build`` is the build and write of the stored
graph that the graph queries read.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from flowgraph.queries import QUERIES, stored_graph, stored_links
from flowgraph.session import build_session

HEADLINE = [
    "broken_flows",
    "top_products_by_billing_docs",
    "billing_to_journal",
    "deliveries_per_order",
    "clearing_documents",
    "graph_nodes",
    "graph_edges",
    "graph_build",
    "node_degrees",
    "neighbors_out",
    "neighbors_in",
    "neighbors_both",
    "khop_reach",
    "subgraph_nodes",
    "subgraph_edges",
    "subgraph_capped",
    "focus_subgraph",
    "audit_dangling_refs",
    "triage_status",
    "triage_answers",
    "attr_relevance",
    "edge_captions",
]


def time_duckdb(sf_dir: str, cpus: str, names: list[str]) -> dict[str, float]:
    """The oracles of the queries, run to the last row in DuckDB."""
    from check import open_oracle
    from flowgraph.oracle import oracle_sql

    con = open_oracle(sf_dir)
    con.execute(f"SET threads = {cpus}")
    seconds = {}
    for name, sql in oracle_sql().items():
        if name in names:
            start = time.perf_counter()
            con.execute(f"CREATE OR REPLACE TEMP TABLE result AS {sql}")
            seconds[name] = round(time.perf_counter() - start, 3)
    return seconds


def run(spark: SparkSession, name: str, sf_dir: str) -> None:
    if name == "graph_build":
        stored_graph(spark, sf_dir)
        stored_links(spark, sf_dir)
    else:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count())
    if sys.argv[1:2] == ["--duckdb"]:
        print(json.dumps({"engine": "duckdb", "queries": time_duckdb(sf_dir, cpus, sys.argv[2:] or HEADLINE)}))
        return
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        # Small data: keep a task per core instead of one 64 MB partition per union branch.
        spark__sql__adaptive__advisoryPartitionSizeInBytes="2m",
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or HEADLINE
    if wanted == ["all"]:
        wanted = ["graph_build", *QUERIES]
    warm_dir = os.environ.get("BENCH_WARM_DIR", os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001"))
    if warm_dir and os.path.isdir(warm_dir):
        for name in wanted:
            run(spark, name, warm_dir)
    if "graph_build" not in wanted:
        run(spark, "graph_build", sf_dir)
    seconds: dict[str, float] = {}
    for name in wanted:
        start = time.perf_counter()
        run(spark, name, sf_dir)
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total wall time of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
