"""All registered queries of the engine, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrace.plans import queries as layer_queries
from terrace.plans import spatial


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return layer_queries.QUERIES | spatial.QUERIES


def oracle_sql() -> dict[str, str]:
    return layer_queries.SQL | spatial.SQL
