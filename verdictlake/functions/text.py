"""String functions as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

CLIP = 240
NO_SCORE = "n/a (no scoreable mutants)"
NOT_SCORED = "excluding invalid/timeout/unknown/unsupported/equivalent"


def collapse_spaces(c: Column) -> Column:
    """Runs of Unicode white space become one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def clip_message(c: Column, limit: int = CLIP) -> Column:
    """At most ``limit`` code points, with an ellipsis where something was cut; white space at the ends goes first."""
    s = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.when(F.length(s) > limit, F.concat(F.substring(s, 1, limit), F.lit("…"))).otherwise(s)


def clip_statement(c: Column, limit: int) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)


def escape_data(c: Column) -> Column:
    """Workflow-command data: percent first, then line ends."""
    return F.replace(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def escape_property(c: Column) -> Column:
    return F.replace(F.replace(escape_data(c), F.lit(":"), F.lit("%3A")), F.lit(","), F.lit("%2C"))


def quote_meta(c: Column) -> Column:
    """The text as a regular expression that matches it alone."""
    return F.regexp_replace(c, r"([\\.+*?()|\[\]{}^$])", r"\\$1")


def path_suffixes(path: Column) -> Column:
    """``a/b/c`` gives ``a/b/c``, ``b/c`` and ``c``."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def clean_path(path: Column, root: str) -> Column:
    """Forward slashes, no ``.`` steps or doubled slashes; a path under ``root`` becomes relative."""
    slashes = F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/(\\./)+", "/"), "/{2,}", "/")
    plain = F.regexp_replace(slashes, "^(\\./)+", "")
    prefix = root.rstrip("/") + "/"
    return F.when(plain.startswith(prefix), F.substring(plain, len(prefix) + 1, F.length(plain))).otherwise(plain)


def old_text(diff: Column) -> Column:
    """Removed lines of a diff's first hunk, up to its first added line; file headers do not count."""
    after = F.regexp_replace(F.concat(F.lit("\n"), diff), r"(?s)^.*?\n(?=@@ )", "")
    hunk = F.when(F.concat(F.lit("\n"), diff).contains("\n@@ "), after).otherwise("")
    before_added = F.regexp_replace(hunk, r"(?s)\n\+.*$", "")
    removed = F.filter(F.split(before_added, "\n"), lambda x: x.startswith("-"))
    return F.array_join(F.transform(removed, lambda x: F.substring(x, 2, F.length(x))), "\n")


def log_line(c: Column) -> Column:
    """struct(ok, file, line, message) of a test log line: indented ``name.go:number: message``, no control line."""
    s = F.regexp_replace(c, r"[\r\n]+$", "")
    shape = r"(?s)^[ \t]+(?!=== |--- )((?:(?!\.go:).)*\.go):\+?(\d{1,18}): ?(.*)$"
    ok = s.rlike(shape) & F.coalesce(F.regexp_extract(s, shape, 2).try_cast("bigint") > 0, F.lit(False))
    part = lambda i: F.when(ok, F.regexp_extract(s, shape, i))
    return F.struct(ok.alias("ok"), part(1).alias("file"), part(2).try_cast("bigint").alias("line"), part(3).alias("message"))


def split_comma(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def failing_tests(c: Column) -> Column:
    """Sorted distinct names in ``--- FAIL: name`` lines."""
    return F.sort_array(F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?m)^\s*--- FAIL: (\S+)"), F.lit(1))))


def is_generated(source: Column) -> Column:
    """Whether the first 2048 bytes say that the file is generated and must not be edited."""
    head = F.substring(F.encode(source, "UTF-8"), 1, 2048)
    has = lambda marker: F.contains(head, F.encode(F.lit(marker), "UTF-8"))
    return has("Code generated") & has("DO NOT EDIT")


@F.pandas_udf(StringType())
def one_decimal(x: pd.Series) -> pd.Series:
    """One decimal of the exact binary value, halves to even; a row or two for each report."""
    return x.map(lambda v: None if v is None or v != v else f"{v:.1f}")


def score_text(score: Column, scored: Column) -> Column:
    return F.when(scored > 0, F.concat(one_decimal(score), F.lit("% " + NOT_SCORED))).otherwise(NO_SCORE)
