"""Ordered spools: rows written once with their ordinals, read again in order and checked for loss."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class BadSpool(ValueError):
    """A spool lacks rows or has too many."""


def write_spool(rows: DataFrame, path: str, *, ordinal: str = "ordinal", mode: str = "errorifexists") -> int:
    """Write ``rows`` sorted by ``ordinal`` inside ranges of it, and how many there are; Spark spills what does not fit in memory."""
    n = rows.count()
    rows.repartitionByRange(ordinal).sortWithinPartitions(ordinal).write.mode(mode).parquet(path)
    return n


def spool_problems(rows: DataFrame, expected: int, *, ordinal: str = "ordinal") -> DataFrame:
    """(problem, ordinal, n): ordinals that repeat, and those outside of 0 to ``expected`` - 1; with as many rows as expected and neither, none is missing."""
    counts = rows.groupBy(ordinal).agg(F.count("*").alias("n"))
    problem = F.when((F.col(ordinal) < 0) | (F.col(ordinal) >= expected), "extra").when(F.col("n") > 1, "repeated")
    return counts.withColumn("problem", problem).where(F.col("problem").isNotNull()).select("problem", ordinal, "n")


def read_spool(spark: SparkSession, path: str, expected: int, *, ordinal: str = "ordinal") -> DataFrame:
    """The spool in order; ``BadSpool`` unless it holds exactly the ordinals 0 to ``expected`` - 1. May be read any number of times."""
    rows = spark.read.parquet(path)
    if rows.count() != expected or not spool_problems(rows, expected, ordinal=ordinal).isEmpty():
        raise BadSpool(f"{path} does not hold the rows 0 to {expected - 1} once each")
    return rows.orderBy(ordinal)
