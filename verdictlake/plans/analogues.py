"""The driver's tables read as experiment records: which columns play which part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERDICT_OF = {"purchase": "KILLED", "error": "SURVIVED", "click": "INVALID", "view": "TIMEOUT", "signup": "UNKNOWN"}
ACTION_OF = {"view": "run", "click": "output", "purchase": "pass", "signup": "skip", "error": "fail"}
CODES = ("KILLED", "SURVIVED", "INVALID", "TIMEOUT", "UNKNOWN")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapped(c: Column, to: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in to.items() for x in kv)), c)


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("verdict", mapped(F.col("event_type"), VERDICT_OF))


def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).where(F.col("event_id") % 7 != 0).select(F.col("event_id").alias("id"), "verdict", "user_id")


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.try_element_at(F.create_map(*(F.lit(x) for i, v in enumerate(CODES) for x in (v, i))), F.col("verdict"))
    turned = F.get(F.array(*map(F.lit, CODES)), ((code + F.col("event_id") % 3) % 5).cast("int"))
    return results(spark, sf_dir).where(F.col("event_id") % 5 != 0).select(F.col("event_id").alias("id"), turned.alias("verdict"), "user_id")


def _case(column: str, to: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in to.items()) + " END"


VERDICT_SQL = _case("event_type", VERDICT_OF)
ACTION_SQL = _case("event_type", ACTION_OF)
_CODE_SQL = "CASE v " + " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(CODES)) + " END"
#: Common table expressions b and c (id, verdict) of the two runs.
RUNS_SQL = f"""
b AS (SELECT event_id AS id, {VERDICT_SQL} AS verdict, user_id FROM events WHERE event_id % 7 <> 0),
c AS (SELECT id, CASE (code + id % 3) % 5 {" ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(CODES))} END AS verdict, user_id
      FROM (SELECT event_id AS id, {_CODE_SQL} AS code, user_id FROM (SELECT event_id, user_id, {VERDICT_SQL} AS v FROM events WHERE event_id % 5 <> 0)))"""
ACTIONABLE_SQL = "('SURVIVED', 'TIMEOUT', 'UNKNOWN')"
COMPARED_SQL = f"""
x AS (SELECT coalesce(b.id, c.id) AS id, b.verdict AS bv, c.verdict AS cv, c.id IS NOT NULL AS has_c, coalesce(c.user_id, b.user_id) AS user_id FROM b FULL OUTER JOIN c ON b.id = c.id),
y AS (SELECT *, coalesce(bv IN {ACTIONABLE_SQL}, false) AS ba, coalesce(cv IN {ACTIONABLE_SQL}, false) AS ca FROM x),
z AS (SELECT *, CASE WHEN NOT has_c THEN 'removed_mutants' WHEN NOT ba AND ca THEN 'new_survivors'
        WHEN ba AND ca AND bv <> cv THEN CASE WHEN cv = 'SURVIVED' THEN 'new_survivors' ELSE 'still_open' END
        WHEN ba AND NOT ca THEN CASE WHEN cv = 'KILLED' THEN 'fixed_survivors' ELSE 'reclassified' END ELSE 'unchanged' END AS bucket FROM y)"""
COUNTS_SQL = """count(*) AS generated, count(*) FILTER (WHERE v = 'KILLED') AS killed, count(*) FILTER (WHERE v = 'SURVIVED') AS survived,
 count(*) FILTER (WHERE v = 'INVALID') AS invalid, count(*) FILTER (WHERE v = 'TIMEOUT') AS timeout, count(*) FILTER (WHERE v = 'UNKNOWN') AS unknown,
 count(*) FILTER (WHERE v = 'UNSUPPORTED') AS unsupported, count(*) FILTER (WHERE v = 'EQUIVALENT') AS equivalent"""
SCORE_SQL = "CASE WHEN killed + survived > 0 THEN 100.0::DOUBLE * killed / (killed + survived) ELSE 0.0::DOUBLE END"
TEXT_SQL = "CASE WHEN killed + survived > 0 THEN printf('%.1f', score) || '% excluding invalid/timeout/unknown/unsupported/equivalent' ELSE 'n/a (no scoreable mutants)' END"
