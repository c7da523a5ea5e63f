"""Registry of the span queries: name -> plan, and name -> equivalent SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def plan(name: str, sql: str | None = None):
    """Register a plan, with its SQL counterpart where there is one."""

    def keep(f):
        PLANS[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


#: Modules that register plans.
MODULES = ("text", "matching", "spans", "metrics", "annotation", "records")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"quillspan.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(PLANS)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
