"""Selection: changed lines, order, top-K with a full count, duplicate ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG_SPAN = 64


def on_changed_lines(spans: DataFrame, changed: DataFrame | None, *, file: str = "file", start: str = "start_line", end: str = "end_line", line: str = "line") -> DataFrame:
    """Spans that touch a changed line of their file; line 0 stands for the whole file. Without ``changed`` all stay.

    A span asks for its own lines by equality, so that a file with very many changed lines is never scanned for each of
    its spans; spans of more than ``LONG_SPAN`` lines, which are few, meet the file's lines by their range.
    """
    if changed is None:
        return spans
    c = changed.select(F.col(file).alias("_f"), F.col(line).alias("_l")).distinct()
    long = F.col(end) - F.col(start) >= LONG_SPAN
    held = spans.withColumn("_span", F.struct(*spans.columns))
    asked = F.concat(F.array(F.lit(0).cast("bigint")), F.when(long | (F.col(end) < F.col(start)), F.array().cast("array<bigint>")).otherwise(F.sequence(F.col(start).cast("bigint"), F.col(end).cast("bigint"))))
    spots = held.select("_span", F.explode(F.array_distinct(asked)).alias("_at"))
    touched = spots.join(c, (F.col(f"_span.{file}") == F.col("_f")) & (F.col("_at") == F.col("_l")), "left_semi").select("_span").distinct()
    by_line = touched.select("_span").withColumn("_one", F.lit(1))
    near = held.where(~long | long.isNull()).join(by_line.select(F.col("_span").alias("_s")), F.col("_span").eqNullSafe(F.col("_s")), "left_semi")
    whole = F.col("_l") == 0
    far = held.where(long).join(c, (F.col(file) == F.col("_f")) & (whole | F.col("_l").between(F.col(start), F.col(end))), "left_semi")
    return near.unionByName(far).select(*spans.columns)


def changed_lines(tracked: DataFrame, untracked: DataFrame, *, file: str = "file", line: str = "line") -> DataFrame:
    """Changed lines of tracked files and line 0 of untracked ones, which take the place of any others of that file."""
    whole = untracked.select(file).distinct()
    return tracked.select(file, line).distinct().join(whole, file, "left_anti").unionByName(whole.withColumn(line, F.lit(0).cast(tracked.schema[line].dataType)))


def top_k_with_total(rows: DataFrame, order: list, k: int, total: str = "total") -> DataFrame:
    """The first ``k`` rows (all for 0) and in each the number of all rows, counted apart from the limit."""
    if k < 0:
        raise ValueError("a limit may not be negative")
    counted = rows.agg(F.count("*")).scalar()
    kept = rows.orderBy(*order).limit(k) if k else rows
    return kept.withColumn(total, counted)


def duplicate_ids(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def source_files(packages: DataFrame, *, lists: tuple[str, ...] = ("GoFiles", "CgoFiles"), directory: str = "Dir", owner: str = "ImportPath") -> DataFrame:
    """(file, package): distinct files of all packages, each with the owner that comes last."""
    files = F.array_distinct(F.concat(*(F.coalesce(F.col(c), F.array().cast("array<string>")) for c in lists)))
    each = packages.select(F.col(owner).alias("package"), F.col(directory).alias("_dir"), F.explode(files).alias("_name"))
    path = F.when(F.coalesce(F.col("_dir"), F.lit("")) == "", F.col("_name")).otherwise(F.concat_ws("/", "_dir", "_name"))
    return each.select(path.alias("file"), "package").groupBy("file").agg(F.max("package").alias("package"))


def discovery_order(rows: DataFrame, columns: tuple[str, ...] = ("file", "start_byte", "id")) -> DataFrame:
    return rows.orderBy(*columns)


def skipped_path(path: str = "path", *, directories: tuple[str, ...] = (".git", "node_modules")):
    """Whether a path lies in one of ``directories``, at any depth."""
    return F.exists(F.split(F.col(path), "/"), lambda p: p.isin(*directories))
