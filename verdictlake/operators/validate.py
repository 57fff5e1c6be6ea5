"""Integrity checks as tables of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rows: DataFrame, subject: str, problem: str, broken: Column) -> DataFrame:
    """(problem, subject) of the rows for which ``broken`` holds; unknown counts as broken."""
    return rows.where(F.coalesce(broken, F.lit(True))).select(F.lit(problem).alias("problem"), F.col(subject).cast("string").alias("subject"))


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    found = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    return found.select(F.lit("duplicate id").alias("problem"), F.concat_ws("/", *keys).alias("subject"))


def recount(headers: DataFrame, rows: DataFrame, key: str, owner: str, said: str) -> DataFrame:
    """Headers that say another number of rows than there are."""
    counts = rows.groupBy(F.col(owner).alias("_owner")).agg(F.count("*").alias("_n"))
    joined = headers.join(counts, F.col(key) == F.col("_owner"), "left")
    return violations(joined, key, "count differs", F.coalesce("_n", F.lit(0)) != F.col(said))
