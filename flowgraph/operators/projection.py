"""Raw tables -> property graph.

Nodes: all sources of a node type are unioned and reduced to one row per key
by a ``min(struct)`` aggregate.  That combines on the map side, so a key that
holds a third of the rows costs one row per task, where a ranking window
would send all of them to one task.
Of a type with one source only rows whose key may recur go through it; all
others are one per key as they are.

Edges: ids are functions of the keys, so an edge needs no lookup of its end
nodes, only proof that they exist.  Where the edge's own source row defines
the node this is certain and no join is planned; elsewhere a left semi join on
the key gives it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import edge_key, node_key, node_key_sql, uuid5
from ..functions.values import fill_template, json_object, present
from ..specs import EDGE_SPECS, NODE_SPECS, EdgeSpec, Endpoint, NodeSource, NodeSpec

RawTables = Mapping[str, DataFrame]
# A source of so few columns is reduced to its different rows before anything is sorted.
FEW_COLUMNS = 4

# Hashes of keys that are told apart; bits of the map of keys that recur (at most 16 MB), a divisor of them; and bits of
# a piece of the map, which ``bitmap_construct_agg`` fixes.
HASHES, MAP_BITS, PIECE_BITS = 1 << 40, 1 << 27, 1 << 15

RowsOf = Callable[[str, tuple[str, ...]], DataFrame]


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# --------------------------------------------------------------------------- nodes


def source_rows(raw: RawTables, spec: NodeSpec, source: NodeSource, once: bool = False) -> DataFrame:
    """Keyed rows of one source, before conflicts are resolved.

    ``once`` reduces a source of few columns (a key and little else) to its
    different rows, by a hash aggregate that combines on the map side.
    """
    attrs = [f"{source.attrs[a]} AS {a}" if a in source.attrs else f"CAST(NULL AS STRING) AS {a}" for a in spec.attr_names]
    rows = raw[source.table].where(present(*source.keys))
    columns = list(dict.fromkeys([*source.keys, *source.attrs.values()]))
    if once and len(columns) <= FEW_COLUMNS:
        rows = rows.select(*columns).distinct()
    return rows.selectExpr(
        f"{node_key_sql(spec.node_type, *source.keys)} AS node_key",
        f"{source.rank} AS source_rank",
        *attrs,
        f"'{source.table}' AS raw_table",
    )


def node_rows(raw: RawTables, node_type: str, attrs: Iterable[str] | None = None) -> DataFrame:
    """One typed row per node: key, winning source, attributes as columns.

    If only some ``attrs`` are wanted, the winner is sought by the attributes
    up to the last of them: the first fields of the smallest row are the
    smallest first fields, so the result is the same with less to compare and
    shuffle.
    """
    spec = NODE_SPECS[node_type]
    names = spec.attr_names
    if attrs is None:
        fields = ["source_rank", *names, "raw_table"]
    else:
        fields = ["source_rank", *names[: max((names.index(a) + 1 for a in attrs), default=0)]]
    rows = union_all([source_rows(raw, spec, s, once=True) for s in spec.sources])
    if fields == ["source_rank"]:  # numbers alone are compared in a hash aggregate
        return rows.groupBy("node_key").agg(F.min("source_rank").alias("source_rank"))
    winner = F.expr(f"min(struct({', '.join(fields)}))").alias("w")

    def winners(rows: DataFrame) -> DataFrame:
        return rows.groupBy("node_key").agg(winner).select("node_key", "w.*")

    if attrs is None and len(spec.sources) == 1:  # hardly any key recurs: only rows of those that may are moved
        again = recurring(rows, "node_key")
        return again.where("NOT again").select("node_key", *fields).unionByName(winners(again.where("again")))
    return winners(rows)


def recurring(rows: DataFrame, key: str) -> DataFrame:
    """The rows and ``again``: false only where no other row has the key.

    Hashes of keys are counted, and those met again set bits of a map of at most ``MAP_BITS``, sent to all tasks in
    pieces of 4 KB.  So rows cross the network as hashes only; two keys that share a bit are taken for one that recurs.
    """
    place = f"pmod(xxhash64({key}), {MAP_BITS})"
    counted = rows.select(F.expr(f"pmod(xxhash64({key}), {HASHES})").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    at = counted.where("n > 1").select(F.expr(f"pmod(h, {MAP_BITS})").alias("at"))
    pieces = at.groupBy(F.expr(f"at div {PIECE_BITS}").alias("piece")).agg(
        F.expr(f"bitmap_construct_agg(at % {PIECE_BITS})").alias("bits")
    )
    found = rows.withColumn("at", F.expr(place)).join(F.broadcast(pieces), F.expr(f"at div {PIECE_BITS} = piece"), "left")
    byte = f"CAST(conv(hex(substring(bits, CAST(at % {PIECE_BITS} div 8 AS INT) + 1, 1)), 16, 10) AS INT)"
    bit = F.expr(f"coalesce(getbit({byte}, CAST(at % 8 AS INT)) = 1, false)")
    return found.withColumn("again", bit).drop("at", "piece", "bits")


def english_descriptions(raw: RawTables) -> DataFrame:
    """One English description per product, the smallest if there are several."""
    return (
        raw["product_descriptions"]
        .where((F.col("language") == "EN") & F.col("product").isNotNull())
        .groupBy(F.col("product").alias("described_product"))
        .agg(F.min("product_description").alias("description"))
    )


def product_labels(rows: DataFrame, raw: RawTables) -> DataFrame:
    """Product rows with ``label``: the English description, else ``Product <id>``."""
    return (
        rows.join(english_descriptions(raw), F.col("product") == F.col("described_product"), "left")
        .withColumn("label", F.coalesce("description", fill_template(NODE_SPECS["Product"].label)))
        .drop("described_product", "description")
    )


def attrs_json(spec: NodeSpec) -> Column:
    """Attribute JSON with exactly the keys of the winning source."""
    by_rank = {s.rank: json_object({a: a for a in s.attrs}) for s in spec.sources}
    *first, last = sorted(by_rank)
    out = by_rank[last]
    for rank in reversed(first):
        out = F.when(F.col("source_rank") == rank, by_rank[rank]).otherwise(out)
    return out


def render_nodes(rows: DataFrame, node_type: str) -> DataFrame:
    """Typed node rows -> the node table's columns."""
    spec = NODE_SPECS[node_type]
    label = F.col("label") if node_type == "Product" else fill_template(spec.label)
    return rows.select(
        uuid5("node_key").alias("node_id"),
        "node_key",
        F.lit(node_type).alias("node_type"),
        "raw_table",
        label.alias("label"),
        attrs_json(spec).alias("attrs"),
    )


def nodes_of_type(raw: RawTables, node_type: str, known: DataFrame | None = None) -> DataFrame:
    rows = node_rows(raw, node_type)
    if known is not None:
        rows = insert_new(known, rows, "node_key")
    if node_type == "Product":
        rows = product_labels(rows, raw)
    return render_nodes(rows, node_type)


def build_nodes(raw: RawTables, node_types: list[str] | None = None, known: DataFrame | None = None) -> DataFrame:
    """The node table, without the keys of the stored nodes ``known``.  Each type is a branch of the union, so a
    filter on ``node_type`` leaves only the branches asked for.

    What is known is left out before ids, labels and JSON are made, so these are not exchanged for it."""
    return union_all([nodes_of_type(raw, t, known) for t in node_types or NODE_SPECS])


def rows_of_nodes(nodes: DataFrame, node_type: str, attrs: tuple[str, ...]) -> DataFrame:
    """Keys and the named attributes of a stored node table (one parse of ``attrs``)."""
    found = nodes.where(F.col("node_type") == node_type)
    if not attrs:
        return found.select("node_key")
    schema = ", ".join(f"`{a}` string" for a in attrs)
    return found.select("node_key", F.from_json("attrs", schema).alias("a")).select("node_key", "a.*")


# --------------------------------------------------------------------------- edges


def end_key(end: Endpoint) -> Column:
    return node_key(end.node_type, *end.keys)


def certain(spec: EdgeSpec, end: Endpoint) -> bool:
    """Whether a source row with its key parts present is itself a definition of the node."""
    table, keys = spec.source, end.keys
    if spec.from_nodes:
        if end.node_type == spec.source:
            return True
        origin = NODE_SPECS[spec.source].sources[0]
        table, keys = origin.table, tuple(origin.attrs.get(k, k) for k in end.keys)
    return any(s.table == table and s.keys == keys for s in NODE_SPECS[end.node_type].sources)


def _readable(spec: EdgeSpec) -> bool:
    """Whether the end keys alone tell their parts and the evidence, even if ids hold a ``|``.

    A key of one part tells it; a key of several tells one if the others are
    known.  Such edges are de-duplicated on the short source columns by a hash
    aggregate, before any key text is built.
    """
    known: set[str] = set()
    parts = [e.keys for e in (spec.src, spec.dst)]
    for _ in parts:
        for keys in parts:
            unknown = [k for k in keys if k not in known]
            if len(unknown) == 1:
                known.add(unknown[0])
    return known >= {k for keys in parts for k in keys} | set(spec.evidence.values())


def _attrs_read(spec: EdgeSpec) -> tuple[str, ...]:
    """The node attributes a rule over node rows reads."""
    return tuple(dict.fromkeys([*spec.src.keys, *spec.dst.keys, *spec.evidence.values(), *spec.required]))


def edge_candidates(raw: RawTables, spec: EdgeSpec, rows_of: RowsOf) -> DataFrame:
    """What the rows of one rule name, one row per edge: end keys and evidence columns; an end need not exist."""
    source = rows_of(spec.source, _attrs_read(spec)) if spec.from_nodes else raw[spec.source]
    ends = {"src_key": spec.src, "dst_key": spec.dst}
    needed = [*spec.required, *[k for e in ends.values() if certain(spec, e) for k in e.keys]]
    source = source.where(present(*dict.fromkeys(needed)))
    readable = _readable(spec)
    if readable and not spec.from_nodes:
        source = source.select(*dict.fromkeys([*spec.src.keys, *spec.dst.keys])).distinct()
    rows = source.select(
        *[end_key(e).alias(name) for name, e in ends.items()],
        *[F.col(c).alias(n) for n, c in spec.evidence.items()],
    )
    if not readable and not spec.from_nodes:  # node rows are one per key already
        rows = rows.groupBy("src_key", "dst_key").agg(F.min(F.struct(*spec.evidence)).alias("e"))
        rows = rows.select("src_key", "dst_key", "e.*")
    return rows


def edge_rows(raw: RawTables, spec: EdgeSpec, rows_of: RowsOf) -> DataFrame:
    """Edges of one rule as typed rows: the candidates whose ends exist."""
    rows = edge_candidates(raw, spec, rows_of)
    for name, end in {"src_key": spec.src, "dst_key": spec.dst}.items():
        if not certain(spec, end):
            known = rows_of(end.node_type, ()).select(F.col("node_key").alias(name))
            rows = rows.join(known, name, "left_semi")
    return rows


def render_edges(rows: DataFrame, spec: EdgeSpec, known: DataFrame | None = None) -> DataFrame:
    """Typed edge rows -> the edge table's columns, without the keys of the stored edges ``known``."""
    keyed = rows.withColumn("edge_key", edge_key(spec.code, "src_key", "dst_key"))
    if known is not None:
        keyed = insert_new(known, keyed, "edge_key")
    return keyed.select(
        uuid5("edge_key").alias("edge_id"),
        "edge_key",
        uuid5("src_key").alias("src_node_id"),
        uuid5("dst_key").alias("dst_node_id"),
        F.lit(spec.code).alias("edge_type"),
        json_object({n: n for n in spec.evidence}).alias("evidence"),
    )


def build_edges(
    raw: RawTables, names: list[str] | None = None, nodes: DataFrame | None = None, known: DataFrame | None = None
) -> DataFrame:
    """The edge table, or the rules in ``names``, without the keys of the stored edges ``known``.

    With a stored ``nodes`` table the existence checks and item attributes are
    read from it, so nodes of earlier loads count; without one they are
    derived from the raw tables.
    """

    @cache
    def rows_of(node_type: str, attrs: tuple[str, ...]) -> DataFrame:
        return node_rows(raw, node_type, attrs) if nodes is None else rows_of_nodes(nodes, node_type, attrs)

    specs = [EDGE_SPECS[n] for n in names or EDGE_SPECS]
    return union_all([render_edges(edge_rows(raw, s, rows_of), s, known) for s in specs])


# --------------------------------------------------------------------------- conflicts and counts


def insert_new(existing: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """The candidates whose key is not in ``existing`` yet; existing rows always win.

    Candidates must hold each key once.  For edges ``edge_key`` suffices: type
    and end ids are functions of it, so the (source, type, target) constraint
    can only be hit together with it.
    """
    return candidates.join(existing.select(key), key, "left_anti").select(*candidates.columns)


def merge_rows(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Add a payload to what is loaded: rows with a known id are left as they are."""
    others = [c for c in new.columns if c != key]
    once = new.groupBy(key).agg(F.min(F.struct(*others)).alias("w")).select(key, "w.*")
    return existing.unionByName(insert_new(existing, once, key).select(*existing.columns))


def type_counts(rows: DataFrame, column: str) -> DataFrame:
    """Rows per node or edge type, most frequent first."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)
