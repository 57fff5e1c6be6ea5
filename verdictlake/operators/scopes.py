"""Test scopes: the inverted dependency index, lookups with fallback, run expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import quote_meta


def test_scope_index(packages: DataFrame, *, target: str = "ForTest", deps: str = "Deps") -> DataFrame:
    """(package, targets): which test targets can observe each package; a target observes itself, test variants of packages count not."""
    rows = packages.where(F.col(target) != "").select(F.col(target).alias("target"), F.explode(F.concat(F.col(deps), F.array(target))).alias("package"))
    return invert(rows.where(~F.col("package").contains(" [")), "package", "target")


def invert(edges: DataFrame, dep: str, target: str) -> DataFrame:
    """(package, targets as sorted comma-separated text) from edges and each target's edge to itself."""
    both = edges.select(F.col(dep).alias("package"), F.col(target).alias("target")).unionByName(edges.select(F.col(target).alias("package"), F.col(target).alias("target")))
    return both.distinct().groupBy("package").agg(F.array_join(F.sort_array(F.collect_list("target")), ",").alias("targets"))


def lookup(rows: DataFrame, owners: DataFrame, scopes: DataFrame, *, file: str = "file", owner: str = "package", scope: str = "scope", default: Column) -> DataFrame:
    """``rows`` with ``scope``: by the file's owner, or ``default`` on any miss."""
    found = rows.join(owners.select(file, owner), file, "left").join(scopes.select(owner, F.col(scope).alias("_scope")), owner, "left")
    return found.withColumn(scope, F.coalesce("_scope", default)).drop("_scope")


def run_expression(tests: Column, always: Column, requested: Column | None = None) -> Column:
    """An anchored alternation of quoted names, tests first; ``requested`` wins, and without known tests there is none."""
    names = F.transform(F.concat(tests, F.coalesce(always, F.array().cast("array<string>"))), quote_meta)
    made = F.when(F.size(tests) > 0, F.concat(F.lit("^("), F.array_join(names, "|"), F.lit(")$")))
    return made if requested is None else F.when(requested != "", requested).otherwise(made)
