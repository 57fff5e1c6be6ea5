"""All queries of the library and their SQL counterparts, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import core, documents, records


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return core.Q | records.Q | documents.Q


def oracle_sql() -> dict[str, str]:
    return core.SQL | records.SQL | documents.SQL
