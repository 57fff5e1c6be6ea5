"""Coverage: path suffixes, three-valued annotation of spans, covering tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import path_suffixes

#: Lines in one cell of the grid on which long spans and blocks meet.
CELL = 64


def suffix_index(files: DataFrame, file: str = "file") -> DataFrame:
    """(suffix, file) of the path suffixes that exactly one file has; whether line sets agree plays no part."""
    each = files.select(F.col(file).alias("file")).distinct().select("file", F.explode(path_suffixes(F.col("file"))).alias("suffix"))
    return each.groupBy("suffix").agg(F.min("file").alias("file"), F.max("file").alias("_last")).where(F.col("file") == F.col("_last")).select("suffix", "file")


def resolve(spans: DataFrame, index: DataFrame, file: str = "file") -> DataFrame:
    """``spans`` with ``covered_file``: the file itself where it is known, else the file that owns the suffix, else null."""
    exact = index.select(F.col("file").alias("_exact")).distinct()
    owner = index.select(F.col("suffix").alias("_suffix"), F.col("file").alias("_owner"))
    joined = spans.join(exact, F.col(file) == F.col("_exact"), "left").join(owner, F.col(file) == F.col("_suffix"), "left")
    return joined.withColumn("covered_file", F.coalesce("_exact", "_owner")).drop("_exact", "_suffix", "_owner")


def annotate(spans: DataFrame, blocks: DataFrame, *, key: str = "id", file: str = "file", start: str = "start_line", end: str = "end_line", count: str = "count", grid: bool = False) -> DataFrame:
    """``spans`` with ``covered``: true if a block with a count overlaps, false if the file has blocks, null if it has none.

    The join is on the file and, with ``grid``, on the 64-line cell as well, for files with very many blocks.
    """
    known = blocks.select(F.col(file).alias("_known")).distinct()
    hit = blocks.where(F.col(count) > 0).select(F.col(file).alias("_f"), F.col(start).alias("_s"), F.col(end).alias("_e"))
    overlap = (F.col(file) == F.col("_f")) & (F.col(start) <= F.col("_e")) & (F.col(end) >= F.col("_s"))
    mine = spans
    if grid:
        cells = lambda a, b: F.explode(F.sequence(F.floor(a / CELL), F.floor(b / CELL)))
        mine = spans.where(F.col(start) <= F.col(end)).withColumn("_cell", cells(F.col(start), F.col(end)))
        hit = hit.where(F.col("_s") <= F.col("_e")).withColumn("_hit_cell", cells(F.col("_s"), F.col("_e")))
        overlap = overlap & (F.col("_cell") == F.col("_hit_cell"))
    touched = mine.join(hit, overlap, "left_semi").select(F.col(key).alias("_key")).distinct()
    out = spans.join(touched, F.col(key) == F.col("_key"), "left").join(known, F.col(file) == F.col("_known"), "left")
    covered = F.when(F.col("_key").isNotNull(), True).when(F.col("_known").isNotNull(), False)
    return out.withColumn("covered", covered).drop("_key", "_known")


def covering_tests_strict(possible: DataFrame, profiles: DataFrame, *, span: str = "span", package: str = "package", test: str = "test", covered: str = "covered") -> DataFrame:
    """(span, known, tests) with the sorted names of covering tests as one comma-separated text.

    ``possible``: (span, package) that may observe the span; ``profiles``: (span, package, test, covered) with a
    three-valued ``covered``. Unknown if any profile is unknown or any package has none.
    """
    seen = profiles.groupBy(span, package).agg(
        F.bool_or(F.col(covered).isNull()).alias("_unknown"),
        F.collect_set(F.when(F.col(covered), F.col(test))).alias("_tests"),
    )
    joined = possible.select(span, package).distinct().join(seen, [span, package], "left")
    out = joined.groupBy(span).agg(
        F.bool_and(F.col("_unknown").isNotNull() & ~F.coalesce("_unknown", F.lit(True))).alias("known"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("_tests")))).alias("_tests"),
    )
    return out.select(span, "known", F.when(F.col("known"), F.array_join("_tests", ",")).alias("tests"))


def covering_tests(profiles: DataFrame, *, span: str = "span", test: str = "test", covered: str = "covered") -> DataFrame:
    """(span, tests): sorted distinct names of the tests known to cover each span."""
    return profiles.groupBy(span).agg(F.array_join(F.sort_array(F.collect_set(F.when(F.col(covered), F.col(test)))), ",").alias("tests"))


def always_run(targets: DataFrame, packages: DataFrame, *, key: str = "span", package: str = "package", name: str = "name") -> DataFrame:
    """(key, names): sorted distinct names of what always runs in any of a key's packages."""
    return targets.join(packages, package).groupBy(key).agg(F.array_join(F.sort_array(F.collect_set(name)), ",").alias("names"))
