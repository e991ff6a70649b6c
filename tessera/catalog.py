"""All queries of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.queries import fusion, learning, lists, matching, metrics, reports, stories, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (matching, lists, fusion, metrics, text, learning, stories, reports):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= {k: v for k, v in _part.ORACLE_SQL.items() if v}
