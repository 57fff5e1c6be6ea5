"""Verdict predicates and the verdict summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import score_text

VERDICTS = ("KILLED", "SURVIVED", "INVALID", "TIMEOUT", "UNKNOWN", "UNSUPPORTED", "EQUIVALENT")
ACTIONABLE = ("SURVIVED", "TIMEOUT", "UNKNOWN")
CACHEABLE = ("KILLED", "SURVIVED", "INVALID")
COUNTS = ("generated", "killed", "survived", "invalid", "timeout", "unknown", "unsupported", "equivalent")


def actionable(verdict: Column) -> Column:
    return F.coalesce(verdict.isin(*ACTIONABLE), F.lit(False))


def confirmed_survivor(verdict: Column) -> Column:
    return verdict == "SURVIVED"


def cacheable(verdict: Column) -> Column:
    return F.coalesce(verdict.isin(*CACHEABLE), F.lit(False))


def rule_of(verdict: Column) -> Column:
    """The diagnostic id for a verdict; what is none of them counts as unknown."""
    known = F.create_map(*(F.lit(x) for v in VERDICTS for x in (v, f"MUT-{v}")))
    return F.coalesce(F.try_element_at(known, verdict), F.lit("MUT-UNKNOWN"))


def level(verdict: Column, *, survived: str = "warning", other: str = "note") -> Column:
    """Severity of a finding; null for what is no finding."""
    return F.when(verdict == "SURVIVED", survived).when(verdict.isin("TIMEOUT", "UNKNOWN"), other)


def summarize(results: DataFrame, *keys: str, verdict: str = "verdict", with_text: bool = True) -> DataFrame:
    """Counts by verdict and the score, for each value of ``keys``; one row over everything without keys.

    What is no verdict counts as unknown. The score is the killed share of killed and survived in percent, 0 without any.
    """
    v = F.col(verdict)
    named = [F.count_if(v == x).alias(x.lower()) for x in VERDICTS if x != "UNKNOWN"]
    rest = F.count_if(~F.coalesce(v.isin(*(x for x in VERDICTS if x != "UNKNOWN")), F.lit(False))).alias("unknown")
    counts = (results.groupBy(*keys) if keys else results.groupBy()).agg(F.count("*").alias("generated"), *named, rest)
    scored = F.col("killed") + F.col("survived")
    score = F.when(scored > 0, F.lit(100.0) * F.col("killed") / scored).otherwise(F.lit(0.0))
    out = counts.select(*keys, *COUNTS, score.alias("score"))
    return out.withColumn("score_text", score_text(F.col("score"), F.col("killed") + F.col("survived"))) if with_text else out
