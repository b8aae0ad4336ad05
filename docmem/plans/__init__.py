"""Named queries over the test tables, each next to its SQL counterpart."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

MODULES = ("folds", "paths", "schemas", "threads", "chunks", "tables", "stores", "extraction", "streams")


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query; `sql` is what DuckDB runs on the same tables."""

    def add(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"docmem.plans.{module}")
