"""All queries of the engine's own operators, by survey row, and the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; without SQL it is held against a plain version in the tests."""

    def keep(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def _load() -> None:
    from folioscope.plans import audit, catalog, graph, identity, ledger, reports, review, search, services, sources, terms, wiki  # noqa: F401


_load()
