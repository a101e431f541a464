"""All registered queries of the evidence operators.

A query is a function of ``v``, which gives tables and fixture views by name; its SQL, if any, names the
same tables and views.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from assayer.plans import fixtures

Views = Callable[[str], DataFrame]
_queries: dict[str, Callable[[Views], DataFrame]] = {}
_sql: dict[str, str] = {}
MODULES = ("verdict_queries", "history_queries", "admission_queries", "graph_queries", "integrity_queries", "search_queries", "scalar_queries", "stream_queries", "record_queries")


def query(sql: str | None = None) -> Callable[[Callable[[Views], DataFrame]], Callable[[Views], DataFrame]]:
    """Register the decorated function under its name, with its SQL."""

    def register(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return register


def _load() -> None:
    for m in MODULES:
        import_module(f"assayer.plans.{m}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict and margin of every attempt's claim on every part's limit."""
    _load()
    return _queries["d1_evaluate_verdicts"](lambda name: fixtures.view(spark, sf_dir, name))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    # A view is made once for each run of a query.
    return {name: lambda spark, sf_dir, f=f: f(cache(lambda view: fixtures.view(spark, sf_dir, view))) for name, f in _queries.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: fixtures.duck(sql) for name, sql in _sql.items()}
