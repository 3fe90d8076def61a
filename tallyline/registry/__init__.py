"""Every operator as a query over the given tables, with the same result in ANSI SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyline.registry import compare_queries, script_queries, table_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]

_FAMILIES = (compare_queries, table_queries, text_queries, script_queries)


def queries() -> dict[str, Query]:
    return {name: query for family in _FAMILIES for name, query in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in _FAMILIES for name, sql in family.ORACLES.items()}
