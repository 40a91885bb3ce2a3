"""Named queries over the tables, for Spark and as SQL."""

from __future__ import annotations

from collections.abc import Callable

from lexloom.operators import building
from lexloom.plans import queries_core, queries_ledger, queries_mining, queries_retrieval, queries_semantic, queries_structure, registry  # noqa: F401
from lexloom.streaming import flows


def queries() -> dict[str, Callable]:
    return {**registry.spark_queries(), **flows.QUERIES, "x_converge": building.converge}


def oracle_sql() -> dict[str, str]:
    return {**registry.duck_sql(), **flows.SQL}
