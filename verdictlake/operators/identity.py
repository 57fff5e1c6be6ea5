"""Identities: mutation ids, cache keys, canonical environments, cache reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .verdicts import cacheable

NUL = "\x00"


def mutation_id(*fields: Column) -> Column:
    """``M-`` and the first 12 hex digits of the SHA-256 of the fields between NULs."""
    return F.concat(F.lit("M-"), F.substring(F.sha2(F.concat_ws(NUL, *(f.cast("string") for f in fields)), 256), 1, 12))


def cache_key(*parts: Column) -> Column:
    """SHA-256 of the parts, each ended by a NUL."""
    return F.sha2(F.concat(*(x for p in parts for x in (F.coalesce(p.cast("string"), F.lit("")), F.lit(NUL)))), 256)


def result_key(fields: dict[str, Column], version: str = "verdictlake.result/1") -> Column:
    """Key of a result: SHA-256 of one JSON object of named fields and a version."""
    return F.sha2(F.to_json(F.struct(F.lit(version).alias("version"), *(c.alias(k) for k, c in sorted(fields.items()))), {"ignoreNullFields": "false"}), 256)


def valid_key(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-f]{64}$"), F.lit(False))


def digest_environment(entries: Column) -> Column:
    return F.sha2(F.array_join(F.sort_array(entries), NUL), 256)


def canonical_environment(rows: DataFrame, keys: list[str], name: str, value: str, order: list[str]) -> DataFrame:
    """The last value for each name."""
    return rows.groupBy(*keys, name).agg(F.max_by(value, F.struct(*order)).alias(value))


def reuse(work: DataFrame, cache: DataFrame, *, key: str = "key", verdict: str = "verdict") -> DataFrame:
    """``work`` with ``hit`` and the cached verdict; entries with bad keys or verdicts that may not be reused are no hits."""
    good = cache.where(valid_key(F.col(key)) & cacheable(F.col(verdict))).select(F.col(key).alias("_key"), F.col(verdict).alias("cached_verdict")).dropDuplicates(["_key"])
    return work.join(good, F.col(key) == F.col("_key"), "left").withColumn("hit", F.col("_key").isNotNull()).drop("_key")


def to_store(results: DataFrame, cache: DataFrame, *, key: str = "key", verdict: str = "verdict") -> DataFrame:
    """Results that the cache should take and has not."""
    return results.where(valid_key(F.col(key)) & cacheable(F.col(verdict))).join(cache.select(key), key, "left_anti")
