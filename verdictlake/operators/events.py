"""Test event streams: classification, evidence and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUILD_FAILED = r"(?md)^FAIL[ \t\n\f\r]+[^ \t\n\f\r]+[ \t\n\f\r]+\[.+\][ \t\n\f\r]*$"
TRACKED = 8192


def test_states(events: DataFrame, *, stream: str = "stream_id", seq: str = "seq", package: str = "Package", test: str = "Test", action: str = "Action") -> DataFrame:
    """(stream, package, test, failed): a failure sticks; a test whose last run was not ended has failed as well."""
    control = events.where((F.col(test) != "") & F.col(action).isin("run", "pass", "skip", "fail"))
    states = control.groupBy(stream, package, test).agg(F.bool_or(F.col(action) == "fail").alias("_fail"), F.max_by(action, seq).alias("_last"), F.bool_or(F.col(action) == "run").alias("ran"))
    return states.select(stream, package, test, (F.col("_fail") | (F.col("_last") == "run")).alias("failed"), "ran")


def classify_streams(events: DataFrame, *, stream: str = "stream_id", seq: str = "seq", package: str = "Package", test: str = "Test", action: str = "Action", output: str = "Output", incomplete: str | None = None, limit: int = TRACKED) -> DataFrame:
    """(stream, verdict, tests): KILLED with the failed tests' names; else UNKNOWN if events were lost, INVALID if a package failed to build and never ran, KILLED."""
    states = test_states(events, stream=stream, seq=seq, package=package, test=test, action=action)
    by_test = states.groupBy(stream).agg(F.sort_array(F.collect_set(F.when(F.col("failed"), F.col(test)))).alias("_names"), F.count("*").alias("_tracked"))
    broken = events.where((F.col(action) == "output") & (F.coalesce(F.col(test), F.lit("")) == "") & F.col(output).rlike(BUILD_FAILED)).select(stream, package).distinct()
    never = broken.join(states.where("ran").select(stream, package).distinct(), [stream, package], "left_anti").groupBy(stream).agg(F.lit(True).alias("_broken"))
    lost = F.bool_or(F.col(incomplete)) if incomplete else F.lit(False)
    all_streams = events.groupBy(stream).agg(lost.alias("_lost"))
    names = F.coalesce("_names", F.array().cast("array<string>"))
    verdict = (
        F.when(F.size(names) > 0, "KILLED").when(F.coalesce("_lost", F.lit(False)) | (F.coalesce("_tracked", F.lit(0)) > limit), "UNKNOWN")
        .when(F.coalesce("_broken", F.lit(False)), "INVALID").otherwise("KILLED")
    )
    joined = all_streams.join(by_test, stream, "left").join(never, stream, "left")
    return joined.select(stream, verdict.alias("verdict"), F.array_join(names, ",").alias("tests"))


def process_verdict(*, timed_out: Column, cancelled: Column, exit_code: Column, n_events: Column, incomplete: Column, stderr_truncated: Column, build_failure: Column, stream_verdict: Column, stream_tests: Column, any_build_failed: Column) -> Column:
    """The verdict of a process: time limit, cancellation, success, no exit status, no events, then the stream's own verdict."""
    return (
        F.when(timed_out, "TIMEOUT").when(cancelled, "UNKNOWN").when(exit_code == 0, "SURVIVED").when(exit_code.isNull(), "UNKNOWN")
        .when(n_events == 0, F.when(incomplete | stderr_truncated, "UNKNOWN").when(build_failure, "INVALID").otherwise("KILLED"))
        .when(stderr_truncated & (stream_verdict == "KILLED") & (stream_tests == 0) & ~any_build_failed, "UNKNOWN")
        .otherwise(stream_verdict)
    )


def first_seen(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Distinct ``keys`` with the first ``seq`` of each."""
    return rows.groupBy(*keys).agg(F.min(seq).alias(seq))


def first_confirmed(events: DataFrame, keys: list[str], seq: str, first: Column, confirm: Column, *carry: str) -> DataFrame:
    """The first row of each group for which ``first`` holds, if ``confirm`` holds in a later one."""
    marked = events.withColumns({"_first": first, "_confirm": confirm})
    heads = marked.groupBy(*keys).agg(
        F.min(F.when(F.col("_first"), F.struct(seq, *carry))).alias("_head"), F.max(F.when(F.col("_confirm"), F.col(seq))).alias("_later")
    )
    return heads.where(F.col("_later") > F.col(f"_head.{seq}")).select(*keys, f"_head.{seq}", *(f"_head.{c}" for c in carry))


def of_failed_tests(events: DataFrame, states: DataFrame, keys: list[str]) -> DataFrame:
    return events.join(states.where("failed").select(*keys).distinct(), keys, "left_semi")


def first_n(rows: DataFrame, key: str, value: str, n: int = 128, out: str = "values") -> DataFrame:
    """(key, the ``n`` smallest values as comma-separated text)."""
    w = Window.partitionBy(key).orderBy(value)
    kept = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return kept.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(value)), lambda x: x.cast("string")), ",").alias(out))


def evidence_budget(events: DataFrame, *, stream: str, seq: str, size: str, max_events: int = 4096, max_bytes: int = 256 << 10) -> DataFrame:
    """Events kept under both budgets, in order; one that does not fit is passed over and later ones may still fit.

    The fold holds one stream's (seq, size) pairs, which the stream's own caps bound.
    """
    fold = F.expr(
        f"aggregate(sort_array(collect_list(struct({seq} as s, cast({size} as bigint) as n))), "
        f"named_struct('kept', cast(array() as array<bigint>), 'used', 0L), (a, x) -> "
        f"if(size(a.kept) >= {max_events} or a.used + x.n > {max_bytes}, a, named_struct('kept', concat(a.kept, array(cast(x.s as bigint))), 'used', a.used + x.n)))"
    )
    return events.groupBy(stream).agg(fold.alias("_a")).select(stream, F.size("_a.kept").cast("long").alias("kept"), F.col("_a.used").alias("used"), F.col("_a.kept").alias("seqs"))
