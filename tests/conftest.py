import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from flowgraph.session import build_session  # noqa: E402
from flowgraph.sources.jsonl import conform  # noqa: E402
from flowgraph.specs import RAW_TABLES  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="8g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoint")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_raw(spark):
    """Raw tables from rows given as dicts; tables not given are empty."""

    def make(**tables):
        raw = {}
        for table in RAW_TABLES:
            rows = tables.get(table, [])
            columns = sorted({c for r in rows for c in r}) or ["dummy"]
            schema = ", ".join(f"{c} string" for c in columns)
            raw[table] = conform(spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], schema), table)
        return raw

    return make


@pytest.fixture(scope="session")
def make_graph(spark):
    """A graph from ``(source, type, target)`` names; ids equal names."""

    def make(edges, lone=()):
        names = sorted({n for s, _, d in edges for n in (s, d)} | set(lone))
        nodes = spark.createDataFrame(
            [(n, f"T:{n}", "T", "t", f"label {n}", "{}") for n in names],
            "node_id string, node_key string, node_type string, raw_table string, label string, attrs string",
        )
        rows = [(f"{t}:{s}->{d}", f"{t}:{s}->{d}", s, d, t, "{}") for s, t, d in edges]
        frame = spark.createDataFrame(
            rows,
            "edge_id string, edge_key string, src_node_id string, dst_node_id string, edge_type string, evidence string",
        )
        return nodes, frame

    return make


def column(df, name):
    return sorted(r[name] for r in df.select(name).collect())
