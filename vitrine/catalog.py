"""Registry of named queries: key -> (spark callable, oracle SQL or None).

Each callable takes ``(spark, sf_dir)``, derives the retail views from the
test tables under ``sf_dir`` and returns the operator's DataFrame, whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vitrine.sources.tables import RetailTables

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def on_tables(fn, **kw) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(RetailTables.from_tpch(spark, sf_dir), **kw)
    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


def register(key: str, query: Query, sql: str | None = None) -> None:
    _QUERIES[key] = query
    if sql is not None:
        _SQL[key] = sql


AREAS = ("prepare", "funnel", "audit", "explore", "cohort", "rfm", "profit", "abtest", "approximate", "ml", "models", "explain")


def _load() -> None:
    """Each operator module lists its registered keys in ``QUERIES``; the
    oracle module of the same area holds the SQL in ``SQL``."""
    if _QUERIES:
        return
    import importlib

    for area in AREAS:
        try:
            ops = importlib.import_module(f"vitrine.operators.{area}")
        except ModuleNotFoundError as e:
            if e.name != f"vitrine.operators.{area}":
                raise
            continue
        try:
            sql = importlib.import_module(f"vitrine.oracle.{area}_sql").SQL
        except ModuleNotFoundError:
            sql = {}
        entries = ops.QUERIES.items() if isinstance(ops.QUERIES, dict) else [(k, getattr(ops, k)) for k in ops.QUERIES]
        for key, fn in entries:
            query = fn if getattr(fn, "takes_session", False) else on_tables(fn)
            register(key, query, sql.get(key))


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
