"""Queries by name; each is one text for Spark and for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}


def query(name: str):
    def add(make):
        if name in QUERIES:
            raise ValueError(f"query {name} twice")
        QUERIES[name] = make
        return make

    return add


def spark_queries() -> dict[str, Callable]:
    from lexloom.plans import dialect, tables

    return {name: lambda s, d, make=make: s.sql(make(dialect.Spark(s, d, tables.SPARK))) for name, make in QUERIES.items()}


def duck_sql() -> dict[str, str]:
    from lexloom.plans import dialect, tables

    out = {}
    for name, make in QUERIES.items():
        m = dialect.Duck(tables.DUCK)
        out[name] = m.finish(make(m))
    return out
