"""Comparison of two runs: buckets, likely shifts, the exploratory form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .verdicts import actionable

BUCKETS = ("new_survivors", "fixed_survivors", "still_open", "reclassified", "removed_mutants", "unchanged")
LOCATION = ("file", "start_line", "start_column", "id")
FINGERPRINT = ("file", "operator", "rule_id", "original", "replacement", "start_column", "end_column", "old_text")


def bucket(has_current: Column, baseline: Column, current: Column) -> Column:
    """The class of an id by its verdicts; the first rule that holds decides."""
    b, c = actionable(baseline), actionable(current)
    return (
        F.when(~has_current, "removed_mutants")
        .when(~b & c, "new_survivors")
        .when(b & c & (baseline != current), F.when(current == "SURVIVED", "new_survivors").otherwise("still_open"))
        .when(b & ~c, F.when(current == "KILLED", "fixed_survivors").otherwise("reclassified"))
        .otherwise("unchanged")
    )


def _last(rows: DataFrame, key: str, order: str | None) -> DataFrame:
    """One row for each key: the last one by ``order``; rows are taken as they are without it."""
    if order is None:
        return rows
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def compare_runs(baseline: DataFrame, current: DataFrame, *, key: str = "id", verdict: str = "verdict", carry: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """(key, baseline_verdict, current_verdict, bucket, carried columns): a full outer join on ``key``.

    Each id falls into exactly one bucket. Carried columns come from the current side, else from the baseline.
    A key that repeats needs ``order``: its last row counts.
    """
    b = _last(baseline.select(key, F.col(verdict).alias("_bv"), F.lit(True).alias("_b"), *(F.col(c).alias(f"_b_{c}") for c in carry), *([order] if order and order not in carry else [])), key, order)
    c = _last(current.select(key, F.col(verdict).alias("_cv"), F.lit(True).alias("_c"), *(F.col(x).alias(f"_c_{x}") for x in carry), *([order] if order and order not in carry else [])), key, order)
    has = F.coalesce(F.col("_c"), F.lit(False))
    sides = [F.when(has, F.col(f"_c_{x}")).otherwise(F.col(f"_b_{x}")).alias(x) for x in carry]
    return b.join(c, key, "full_outer").select(key, F.col("_bv").alias("baseline_verdict"), F.col("_cv").alias("current_verdict"), bucket(has, F.col("_bv"), F.col("_cv")).alias("bucket"), *sides)


def bucket_counts(compared: DataFrame) -> DataFrame:
    return compared.groupBy("bucket").agg(F.count("*").alias("n"))


def removed(baseline: DataFrame, current: DataFrame, key: str = "id") -> DataFrame:
    return baseline.join(current.select(key), key, "left_anti")


def brand_new(baseline: DataFrame, current: DataFrame, key: str = "id") -> DataFrame:
    return current.join(baseline.select(key), key, "left_anti")


def shift_candidates(gone: DataFrame, new: DataFrame, *, fingerprint: tuple[str, ...] = FINGERPRINT, key: str = "id", line: str = "start_line", verdict: str = "verdict") -> DataFrame:
    """Removed and brand-new ids that share a fingerprint which is unique on either side."""
    side = lambda x, p: (
        x.groupBy(*fingerprint).agg(F.count("*").alias("_n"), F.min(key).alias(f"{p}_id"), F.min(line).alias(f"{p}_line"), F.min(verdict).alias(f"{p}_verdict")).where(F.col("_n") == 1).drop("_n")
    )
    both = side(gone, "removed").join(side(new, "new"), list(fingerprint))
    changed = F.col("removed_verdict") != F.col("new_verdict")
    return both.select("removed_id", "new_id", *fingerprint, F.col("removed_line").alias("old_line"), F.col("new_line"), changed.alias("verdict_changed"))


def explore(compared: DataFrame) -> DataFrame:
    """The form for runs that may not be compared: what is missing was not analysed, and changes are unverified."""
    b, c = F.col("baseline_verdict"), F.col("current_verdict")
    state = F.when(c.isNull(), "not_analyzed").when(b.isNull(), F.when(actionable(c), "new_survivors").otherwise("unchanged")).when(b != c, "unverified_changes").otherwise("unchanged")
    return compared.withColumn("exploratory", state)


def incompatibilities(baseline: DataFrame, current: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(field, baseline, current) of the header fields in which two one-row headers differ; nulls are equal."""
    pack = lambda x: F.array(*(F.struct(F.lit(k).alias("field"), F.to_json(F.struct(F.col(k).alias("v"))).alias(x)) for k in keys))
    a = baseline.select(F.explode(pack("baseline")).alias("s")).select("s.field", "s.baseline")
    b = current.select(F.explode(pack("current")).alias("s")).select("s.field", "s.current")
    return a.join(b, "field", "full_outer").where(~F.col("baseline").eqNullSafe(F.col("current")))


def by_location(rows: DataFrame, columns: tuple[str, ...] = LOCATION) -> DataFrame:
    return rows.orderBy(*columns)
