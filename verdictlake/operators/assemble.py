"""Results and reports put together from what a run observed, and the gates on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .verdicts import actionable, rule_of, summarize

CASE_BY_CASE = "one mutation is active at a time"
SELECTED = "the selected tests are those of the command that the report names"
PROOF = "the proof is one of syntax and covers the shown lines only"
MAX_OUTPUT = 64 << 10


def _filled(c: Column) -> Column:
    return F.coalesce(F.size(c) > 0, F.lit(False))


def evidence(*, diff: Column, exit_code: Column, tests: Column, assertions: Column, panics: Column, truncated: Column, output: Column, verdict: Column, covered: Column, coverage_known: Column) -> Column:
    """One JSON object of what was observed: absent where there is nothing to say, the output only where tests noticed."""
    return F.to_json(F.struct(
        diff.alias("source_diff"), exit_code.alias("exit_code"), F.when(_filled(tests), tests).alias("tests"), F.when(_filled(assertions), assertions).alias("assertions"), F.when(_filled(panics), panics).alias("panics"),
        F.when(truncated, F.lit(True)).alias("output_truncated"), F.when((output != "") & (verdict != "SURVIVED"), output).alias("output"), F.when(coverage_known, covered).alias("covered"),
    ))


def diagnose(rows: DataFrame) -> DataFrame:
    """Mutations with a verdict get ``diagnostic_id``, ``statement``, ``assumptions`` and ``suggestion`` (for survivors only).

    A mutation with an ``equivalent_reason`` is EQUIVALENT whatever ``verdict`` says: it needs no run, and its statement is the proof.
    """
    proved = F.coalesce(F.col("equivalent_reason") != "", F.lit(False))
    verdict = F.when(proved, "EQUIVALENT").otherwise(F.col("verdict"))
    said = F.when(proved, F.concat(F.lit("equivalent: "), "equivalent_reason")).otherwise(F.concat(F.lower(verdict), F.lit(": "), "description"))
    assumed = F.when(proved, F.array(F.lit(PROOF))).otherwise(F.array(F.lit(SELECTED), F.lit(CASE_BY_CASE)))
    return rows.withColumns({"statement": said, "assumptions": assumed, "suggestion": F.when(verdict == "SURVIVED", F.col("suggestion")).otherwise(""), "diagnostic_id": rule_of(verdict), "verdict": verdict})


def to_run(mutations: DataFrame) -> DataFrame:
    """The mutations that need a run: those without a proof."""
    return mutations.where(F.coalesce(F.col("equivalent_reason"), F.lit("")) == "")


def report_headers(results: DataFrame, retained: DataFrame, *, run: str = "run") -> DataFrame:
    """One header for each run of ``retained`` (run, discovered, retained): bounds, the summary of its results and whether all that was kept was done."""
    summary = summarize(results, run)
    done = F.coalesce("generated", F.lit(0))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("generated", "killed", "survived", "invalid", "timeout", "unknown", "unsupported", "equivalent")]
    joined = retained.join(summary, run, "left")
    return joined.select(run, (done == F.col("retained")).alias("complete"), F.col("discovered").alias("discovered_before_bound"), F.col("retained").alias("retained_after_bound"), done.alias("completed_mutants"), *counts, F.coalesce("score", F.lit(0.0)).alias("score"))


def test_command(timeout: Column, test_run: Column, patterns: Column, *, events: bool = False) -> Column:
    """The arguments of the test command; ``events`` asks for machine-readable output."""
    head = [F.lit("go"), F.lit("test"), *[F.lit("-json")] * events, F.lit("-count=1"), F.lit("-timeout")]
    chosen = F.when(F.coalesce(test_run, F.lit("")) != "", F.array(F.lit("-run"), test_run)).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(*head, timeout), chosen, patterns)


def untracked_flags(flags: Column) -> Column:
    """Whether flags name files that no digest of the environment covers; results are not reused then."""
    names = ("-modfile", "-overlay", "-toolexec")
    return F.exists(F.split(flags, r"\s+"), lambda x: x.isin(*names) | F.substring_index(x, "=", 1).isin(*names))


def has_own_tests(*lists: Column) -> Column:
    out = F.lit(False)
    for x in lists:
        out = out | _filled(x)
    return out


def toolchain_key(*fields: Column) -> Column:
    return F.concat_ws("|", *(F.coalesce(f, F.lit("")) for f in fields))


def diagnostic_output(stderr: Column, display: Column, *, total: Column, incomplete: Column, limit: int = MAX_OUTPUT) -> Column:
    """Standard error and then the displayed output, ``limit`` bytes in all, cut between characters; says so where something is missing."""
    both = F.encode(F.concat(stderr, display), "UTF-8")
    kept = F.substring(both, 1, limit)
    # a character cut in two leaves up to three bytes too many
    whole = lambda x, i: F.try_validate_utf8(F.substring(x, F.lit(1), F.length(x) - i).cast("string"))
    text = F.element_at(F.transform(F.array(kept), lambda x: F.coalesce(*(whole(x, i) for i in range(4)), F.lit(""))), 1)
    noted = F.when((total > limit) | incomplete, F.concat(F.lit("\n... output cut ("), total.cast("string"), F.lit(" bytes seen)"))).otherwise("")
    return F.trim(F.concat(F.trim(text), noted))


def contiguous(results: DataFrame, planned: DataFrame, *, run: str = "run", ordinal: str = "ordinal") -> DataFrame:
    """(run, committed, complete): how many results stand in an unbroken row from the first ordinal, which is what an interrupted run may report.

    The first gap is the least planned ordinal without a result: an anti-join and a minimum, so that no run's results come together.
    """
    gap = planned.join(results.select(run, ordinal), [run, ordinal], "left_anti").groupBy(run).agg(F.min(ordinal).alias("_gap"))
    all_ = planned.groupBy(run).agg(F.count("*").alias("_n"), F.min(ordinal).alias("_first"))
    committed = F.coalesce(F.col("_gap") - F.col("_first"), F.col("_n"))
    return all_.join(gap, run, "left").select(run, committed.alias("committed"), F.col("_gap").isNull().alias("complete"))


def commit(results: DataFrame, prefixes: DataFrame, *, run: str = "run", ordinal: str = "ordinal", first: int = 0) -> DataFrame:
    """The results inside their run's unbroken row."""
    return results.join(prefixes.select(run, "committed"), run).where(F.col(ordinal) < F.col("committed") + first).drop("committed")


def write_failures(writes: DataFrame, *, run: str = "run", seq: str = "seq", error: str = "error") -> DataFrame:
    """(run, failures, first_error) of cache writes; a failed write costs a later run only."""
    failed = writes.where(F.col(error).isNotNull())
    return failed.groupBy(run).agg(F.count("*").alias("failures"), F.min_by(error, seq).alias("first_error"))


def new_survivor_gate(compared: DataFrame, *, failing: int = 10) -> int:
    """The exit code of a comparison that must not have new survivors."""
    return failing if not compared.where("bucket = 'new_survivors'").isEmpty() else 0


def gates(compared: DataFrame, *keys: str, failing: int = 10) -> DataFrame:
    """(keys, new_survivors, exit_code): the gate of each group of a comparison."""
    n = F.count_if(F.col("bucket") == "new_survivors")
    return compared.groupBy(*keys).agg(n.alias("new_survivors"), F.when(n > 0, failing).otherwise(0).alias("exit_code"))


def open_findings(results: DataFrame, key: str, n: int) -> DataFrame:
    """The first ``n`` actionable results of each ``key`` by place."""
    w = Window.partitionBy(key).orderBy("file", "start_line", "id")
    return results.where(actionable(F.col("verdict"))).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
