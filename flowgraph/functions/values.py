"""Predicates, text normalisation, JSON building and value formatting."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def present(*names: str) -> Column:
    """All columns (or SQL expressions) are neither NULL nor empty."""
    return F.expr(" AND ".join(f"({n} IS NOT NULL AND {n} <> '')" for n in names) or "true")


def strip_zeros(name: str) -> Column:
    """Item number without leading zeros; ``'000000'`` becomes ``''``."""
    return F.expr(f"trim(LEADING '0' FROM {name})")


def pad_item(name: str, width: int = 6) -> Column:
    """Item number padded with zeros to ``width``; longer values are cut to it."""
    return F.expr(f"lpad({name}, {width}, '0')")


# Fixed value: Unicode white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip_text(col: Column) -> Column:
    """Text without leading and trailing white space of any kind, in one pass over each end."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def json_object(fields: dict[str, str]) -> Column:
    """JSON text of name -> SQL expression in the given order; NULL fields stay as ``null``."""
    pairs = ", ".join(f"'{name}', {sql}" for name, sql in fields.items())
    return F.expr(f"to_json(named_struct({pairs}), map('ignoreNullFields', 'false'))")


def fill_template(template: str) -> Column:
    """Concatenate a ``'SO {salesOrder}'``-style template of columns; NULL in, NULL out."""
    pieces: list[str] = []
    for text, field, _, _ in Formatter().parse(template):
        if text:
            pieces.append("'" + text.replace("'", "''") + "'")
        if field:
            pieces.append(field)
    return F.expr(f"concat({', '.join(pieces)})")


def format_cell(col: Column, dtype: T.DataType) -> Column:
    """A table cell as text: NULL is empty, nested values are JSON."""
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        text = F.to_json(col, {"ignoreNullFields": "false"})
    else:
        text = col.cast("string")
    return F.coalesce(text, F.lit(""))


def format_value(col: Column, dtype: T.DataType, max_items: int = 6) -> Column:
    """A tooltip value as text: as a cell, but arrays are ``[a, b]`` or, when long, ``[n items]``."""
    if isinstance(dtype, T.ArrayType):
        items = F.transform(col, lambda x: format_value(x, dtype.elementType, max_items))
        short = F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
        long = F.concat(F.lit("["), F.size(col).cast("string"), F.lit(" items]"))
        return F.coalesce(F.when(F.size(col) <= max_items, short).otherwise(long), F.lit(""))
    return format_cell(col, dtype)
