"""Turn fixed Python values into SQL text and map columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def quoted(text: str) -> str:
    """A Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal(value) -> str:
    if isinstance(value, (list, tuple)):
        return f"cast(array({', '.join(map(literal, value))}) as array<string>)"
    return quoted(value) if isinstance(value, str) else str(value)


def map_text(values: dict) -> str:
    return f"map({', '.join(literal(x) for pair in values.items() for x in pair)})"


def literal_map(values: dict) -> Column:
    return F.expr(map_text(values))


def look_up(values: dict, key: Column, default=None) -> Column:
    found = F.try_element_at(literal_map(values), key)
    return found if default is None else F.coalesce(found, F.lit(default))
