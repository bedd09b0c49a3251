"""Registered queries and their SQL twins, gathered from the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import analytics, curation, lookups, relational, sequential, upkeep

Query = Callable[[SparkSession, str], DataFrame]
MODULES = [relational, analytics, sequential, curation, upkeep, lookups]


def queries() -> dict[str, Query]:
    """Name to query, over all modules."""
    return {k: q for m in MODULES for k, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL, where SQL can express the query."""
    return {k: s for m in MODULES for k, (_, s) in m.QUERIES.items() if s}
