"""Queries over the driver tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MODULES = ("deal_queries", "page_queries", "report_queries", "text_queries", "more_queries", "prose_queries", "form_queries", "venue_queries", "rule_queries", "valid_queries", "display_queries", "place_queries")


def query(sql: str | None = None, name: str | None = None):
    """Registers a query and the SQL for its rows."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def _load() -> None:
    for m in MODULES:
        import_module(f"dealloom.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
