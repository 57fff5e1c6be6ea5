"""Coverage profiles: a mode line, then one block a line; any bad row fails its file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_path

BLOCK = r"^[ \t]*(\S+):(\d{1,18})\.(\d{1,18}),(\d{1,18})\.(\d{1,18})[ \t]+(\d{1,18})[ \t]+(\d{1,18})[ \t\r]*$"
MODES = ("set", "count", "atomic")
MAX_LINES = 1_000_000


class BadProfile(ValueError):
    """Some profiles hold a bad row or no header."""


def parse_block(line: Column, mode: Column) -> Column:
    """struct(ok, file, start_line, start_col, end_line, end_col, statements, count) of one block line; numbers are null unless ok."""
    n = [F.regexp_extract(line, BLOCK, i).try_cast("bigint") for i in range(2, 8)]
    sl, sc, el, ec, statements, count = n
    positions = (sl > 0) & (sc > 0) & (el > 0) & (ec > 0)
    forward = (el > sl) | ((el == sl) & (ec >= sc))
    ok = F.coalesce(line.rlike(BLOCK) & positions & forward & (el - sl < MAX_LINES) & ((mode != "set") | (count <= 1)), F.lit(False))
    names = ("start_line", "start_col", "end_line", "end_col", "statements", "count")
    return F.struct(ok.alias("ok"), F.when(ok, F.regexp_extract(line, BLOCK, 1)).alias("file"), *(F.when(ok, x).alias(k) for x, k in zip(n, names, strict=True)))


def parse_profiles(files: DataFrame, root: str = "", *, profile: str = "profile_id", text: str = "text") -> DataFrame:
    """(profile, mode, ok, file, positions, statements, count) for each line after the header; an empty file gives one row that is not ok."""
    lines = F.split(F.regexp_replace(F.col(text), r"\n\z", ""), "\n")
    mode = F.regexp_extract(F.get(lines, F.lit(0)), r"^mode: (set|count|atomic)\r?$", 1)
    body = F.when(F.size(lines) > 1, F.slice(lines, 2, F.size(lines))).otherwise(F.array().cast("array<string>"))
    rows = files.select(profile, mode.alias("mode"), F.posexplode_outer(body).alias("line_no", "line"))
    rows = rows.withColumn("b", parse_block(F.col("line"), F.col("mode")))
    ok = (F.col("mode") != "") & F.when(F.col("line").isNull(), F.col("line_no").isNull()).otherwise(F.col("b.ok"))
    fields = ("start_line", "start_col", "end_line", "end_col", "statements", "count")
    return rows.select(profile, "mode", ok.alias("ok"), clean_path(F.col("b.file"), root).alias("file") if root else F.col("b.file").alias("file"), *(f"b.{k}" for k in fields))


def read_profiles(spark: SparkSession, path: str, root: str = "") -> DataFrame:
    """Blocks of all profiles at ``path``; fails if any row of any file is bad."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("profile_id"), F.col("value").alias("text"))
    rows = parse_profiles(files, root)
    if bad := [r["profile_id"] for r in rows.where(~F.col("ok")).select("profile_id").distinct().limit(5).collect()]:
        raise BadProfile(f"bad coverage rows in {bad}")
    return rows.where(F.col("file").isNotNull()).drop("ok")
