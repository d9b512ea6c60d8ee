"""Registry of queries: name, function of (spark, folder), and the equivalent DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "surface_zero_crossing"
#: Modules of this package that register queries on import.
MODULES: list[str] = ["encoding", "stencils", "volumes", "measures", "increments", "builds", "extras", "fields", "reports", "composites", "tiling", "faces",
    "shape", "audits", "winding", "warps", "evaluation", "crops", "intensity"]

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Decorator: adds a query under ``name``, with its SQL equivalent."""

    def add(query: Query) -> Query:
        if name in _queries:
            raise ValueError(f"query {name} is registered twice")
        _queries[name] = query
        if sql is not None:
            _oracles[name] = sql
        return query

    return add


def _load() -> None:
    for module in MODULES:
        import_module(f"brickwise.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracles)
