"""Deterministic ids and business keys.

The helpers take column names or SQL expressions and return a Column built
from one SQL text: a graph build holds dozens of them, and a text costs one
call to the JVM instead of one per function.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: namespace of all name-based ids.
ID_NAMESPACE = "4c4d9c7f-8b3d-4f57-8c1d-5d7d1f0f2a11"


def uuid5(name: str, namespace: str = ID_NAMESPACE) -> Column:
    """Name-based UUID (RFC 4122 version 5) of a text expression, from built-in functions; NULL in, NULL out."""
    digest = f"sha1(concat(X'{namespace.replace('-', '')}', CAST({name} AS BINARY)))"
    # The two top bits of hex digit 17 are set to '10': 0-f become 8, 9, a, b in turn.
    variant = f"substring('{'89ab' * 4}', instr('0123456789abcdef', substring({digest}, 17, 1)), 1)"
    return F.expr(
        f"concat(substring({digest}, 1, 8), '-', substring({digest}, 9, 4), '-5', substring({digest}, 14, 3),"
        f" '-', {variant}, substring({digest}, 18, 3), '-', substring({digest}, 21, 12))"
    )


def name_id(name: str) -> str:
    """The same id of one name, on the driver."""
    return str(uuid.uuid5(uuid.UUID(ID_NAMESPACE), name))


def node_key(node_type: str, *parts: str) -> Column:
    """``Type:k1|k2``; NULL as soon as one part is NULL."""
    return F.expr(node_key_sql(node_type, *parts))


def node_key_sql(node_type: str, *parts: str) -> str:
    return f"concat('{node_type}:', {", '|', ".join(parts)})"


def node_key_skipping_nulls(node_type: str, *parts: str) -> Column:
    """As ``node_key``, but a NULL part counts as the empty string."""
    return node_key(node_type, *[f"coalesce({p}, '')" for p in parts])


def edge_key(code: str, src_key: str, dst_key: str) -> Column:
    """``CODE:src->dst``."""
    return F.expr(f"concat('{code}:', {src_key}, '->', {dst_key})")


_UUID = "^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"
_MARK = 17  # zero bytes behind an id of another form, so that it can't be as long as a packed UUID


def packed_id(name: str) -> str:
    """SQL of an id as bytes, 16 for a UUID; different texts stay different, NULL stays NULL.  For exchanges."""
    return (
        f"CASE WHEN {name} RLIKE '{_UUID}' THEN unhex(replace({name}, '-', ''))"
        f" ELSE concat(CAST({name} AS BINARY), X'{'00' * _MARK}') END"
    )


def unpacked_id(name: str) -> str:
    """SQL of the text that ``packed_id`` was made of."""
    text = f"lower(hex({name}))"
    for at in (9, 14, 19, 24):
        text = f"overlay({text} PLACING '-' FROM {at} FOR 0)"
    return f"CASE WHEN octet_length({name}) = 16 THEN {text} ELSE CAST(substring({name}, 1, octet_length({name}) - {_MARK}) AS STRING) END"
