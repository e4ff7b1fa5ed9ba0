"""Registry of queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from checks.adapters import SQL

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def given(*names: str) -> str:
    """Start of a query that uses the named logical tables."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + " "


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return register
