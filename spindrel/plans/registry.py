"""All queries by name, and the SQL of each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spindrel.plans import catalog, changes, ranking, retrieval

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = ranking.QUERIES | catalog.QUERIES | changes.QUERIES | retrieval.QUERIES
SQL: dict[str, str] = ranking.SQL | catalog.SQL | changes.SQL | retrieval.SQL
