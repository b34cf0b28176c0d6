"""Registered queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperweave.plans.views import VIEW_SQL, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def with_views(uses: str, body: str, ctes: str = "") -> str:
    """`body` preceded by the named logical views and further CTEs as a WITH list."""
    parts = [f"{name} AS ({VIEW_SQL[name]})" for name in uses.split()]
    if ctes:
        parts.append(ctes.strip().rstrip(","))
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body


def query(name: str, uses: str = "", sql: str | None = None, ctes: str = ""):
    """Register `fn(views) -> DataFrame` under `name`, with its check SQL if it has one."""

    def register(fn: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = with_views(uses, sql, ctes)
        return fn

    return register
