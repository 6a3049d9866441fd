"""Registered queries: every operator over whole tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catalogue import audits, charts, exchange, fills, learning, outlying, profiling, scale_side

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (profiling, charts, fills, outlying, audits, exchange, learning, scale_side)


def all_queries() -> dict[str, Query]:
    return {name: run for module in MODULES for name, (run, _) in module.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}
