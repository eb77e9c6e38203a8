"""All queries over the driver's tables and their DuckDB counterparts, apart from those of sparkloom.llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import code_queries, commit_queries, detail_queries, diff_queries, source_queries, state_queries, vector_queries

_MODULES = (vector_queries, state_queries, diff_queries, commit_queries, code_queries, detail_queries, source_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
