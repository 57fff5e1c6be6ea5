"""Queries on event streams, texts, validation, streaming and sources."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.batches import bound_batches
from ..functions.diffs import apply_unified, unified_diff
from ..operators import events as E
from ..operators import select, verdicts
from ..sinks import findings
from ..sources.coverage_profile import parse_block
from ..sources.diffs import parse_diffs
from ..streaming.summary import summarize_stream
from . import analogues as A
from .analogues import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_STREAM_SQL = f"""s AS (SELECT user_id::VARCHAR || '/' || strftime(ts, '%d') AS stream_id, event_id AS seq, 'p' || event_id % 3 AS pkg,
  CASE WHEN event_type = 'click' THEN '' ELSE 't' || event_id % 4 END AS test, {A.ACTION_SQL} AS action,
  CASE WHEN event_id % 2 = 0 THEN 'FAIL' || chr(9) || 'x [build failed]' ELSE props END AS output, value < 2 AS lost FROM events),
st AS (SELECT stream_id, pkg, test, bool_or(action = 'fail') OR arg_max(action, seq) = 'run' AS failed, bool_or(action = 'run') AS ran
  FROM s WHERE test <> '' AND action IN ('run', 'pass', 'skip', 'fail') GROUP BY ALL)"""


def _streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "dd")).alias("stream_id"), F.col("event_id").alias("seq"), F.concat(F.lit("p"), (F.col("event_id") % 3).cast("string")).alias("Package"),
        F.when(F.col("event_type") == "click", "").otherwise(F.concat(F.lit("t"), (F.col("event_id") % 4).cast("string"))).alias("Test"), A.mapped(F.col("event_type"), A.ACTION_OF).alias("Action"),
        F.when(F.col("event_id") % 2 == 0, "FAIL\tx [build failed]").otherwise(F.col("props")).alias("Output"), (F.col("value") < 2).alias("lost"),
    )


@query(f"""WITH {_STREAM_SQL},
n AS (SELECT stream_id, string_agg(DISTINCT test, ',' ORDER BY test) FILTER (WHERE failed) AS names FROM st GROUP BY stream_id),
k AS (SELECT DISTINCT stream_id FROM s WHERE action = 'output' AND output LIKE 'FAIL%' AND NOT EXISTS (SELECT 1 FROM st WHERE st.stream_id = s.stream_id AND st.pkg = s.pkg AND ran)),
a AS (SELECT stream_id, bool_or(lost) AS lost FROM s GROUP BY stream_id)
SELECT a.stream_id, CASE WHEN names IS NOT NULL THEN 'KILLED' WHEN lost THEN 'UNKNOWN' WHEN k.stream_id IS NOT NULL THEN 'INVALID' ELSE 'KILLED' END AS verdict, coalesce(names, '') AS tests
FROM a LEFT JOIN n ON a.stream_id = n.stream_id LEFT JOIN k ON a.stream_id = k.stream_id""")
def classify_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.classify_streams(_streams(spark, sf_dir), incomplete="lost")


@query(f"""WITH {_STREAM_SQL} SELECT stream_id, seq, pkg AS "Package", test AS "Test", action AS "Action" FROM s WHERE EXISTS (SELECT 1 FROM st WHERE failed AND st.stream_id = s.stream_id AND st.pkg = s.pkg AND st.test = s.test)""")
def failed_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _streams(spark, sf_dir)
    return E.of_failed_tests(s, E.test_states(s), ["stream_id", "Package", "Test"]).select("stream_id", "seq", "Package", "Test", "Action")


@query("""WITH e AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_id, event_type, props FROM events),
h AS (SELECT user_id, day, min(event_id) FILTER (WHERE event_type = 'error') AS f, max(event_id) FILTER (WHERE event_type = 'purchase') AS l FROM e GROUP BY ALL)
SELECT h.user_id, h.day, f AS event_id, e.props FROM h JOIN e ON e.event_id = h.f WHERE l > f""")
def first_then_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return E.first_confirmed(e, ["user_id", "day"], "event_id", F.col("event_type") == "error", F.col("event_type") == "purchase", "props")


@query("SELECT md5(text) AS body, min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedupe_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.first_seen(table(spark, sf_dir, "documents").select(F.md5("text").alias("body"), "doc_id"), ["body"], "doc_id")


@query("SELECT source, array_to_string(list_sort(list(doc_id))[1:5], ',') AS \"values\" FROM documents GROUP BY source")
def array_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.first_n(table(spark, sf_dir, "documents"), "source", "doc_id", 5)


@query(f"""WITH e AS (SELECT event_id, value > 95 AS t, value < 3 AS c, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 3 END AS x, event_id % 4 AS n, event_id % 5 = 0 AS i, event_id % 7 = 0 AS tr, event_id % 2 = 0 AS bf, {A.VERDICT_SQL} AS v, event_id % 6 AS nt, event_id % 13 = 0 AS ab FROM events)
SELECT event_id, CASE WHEN t THEN 'TIMEOUT' WHEN c THEN 'UNKNOWN' WHEN x = 0 THEN 'SURVIVED' WHEN x IS NULL THEN 'UNKNOWN' WHEN n = 0 THEN CASE WHEN i OR tr THEN 'UNKNOWN' WHEN bf THEN 'INVALID' ELSE 'KILLED' END
 WHEN tr AND v = 'KILLED' AND nt = 0 AND NOT ab THEN 'UNKNOWN' ELSE v END AS verdict FROM e""")
def verdict_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    verdict = E.process_verdict(
        timed_out=F.col("value") > 95, cancelled=F.col("value") < 3, exit_code=F.when(i % 11 != 0, i % 3), n_events=i % 4, incomplete=i % 5 == 0, stderr_truncated=i % 7 == 0, build_failure=i % 2 == 0,
        stream_verdict=F.col("verdict"), stream_tests=i % 6, any_build_failed=i % 13 == 0,
    )
    return A.results(spark, sf_dir).select("event_id", verdict.alias("verdict"))


@query("SELECT doc_id, CASE WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 240 THEN left(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 240) || '…' ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END AS clipped FROM documents")
def clip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.clip_message(F.col("text")).alias("clipped"))


@query("SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS collapsed FROM documents")
def collapse_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.collapse_spaces(F.col("text"))).alias("collapsed"))


@query("WITH e AS (SELECT doc_id, replace(replace(replace(text, '%', '%25'), chr(13), '%0D'), chr(10), '%0A') AS d FROM documents) SELECT doc_id, md5(d) AS data, md5(replace(replace(d, ':', '%3A'), ',', '%2C')) AS property FROM e")
def escape_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.escape_data(F.col("text"))).alias("data"), F.md5(X.escape_property(F.col("text"))).alias("property"))


@query("""WITH l AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '    ' || replace(p_name, ' ', '_') || '.go:' || p_size || ': got ' || p_type WHEN 1 THEN '--- FAIL: ' || p_name WHEN 2 THEN chr(9) || 'x.go:0: zero' ELSE p_name END AS line FROM part),
m AS (SELECT *, regexp_matches(line, '^[ \\t]+.*?\\.go:[0-9]+:') AND regexp_extract(line, '\\.go:([0-9]+):', 1) <> '0' AS ok FROM l)
SELECT p_partkey, ok, CASE WHEN ok THEN regexp_extract(line, '^[ \\t]+(.*?\\.go):', 1) END AS file, CASE WHEN ok THEN CAST(regexp_extract(line, '\\.go:([0-9]+):', 1) AS BIGINT) END AS line, CASE WHEN ok THEN regexp_extract(line, '\\.go:[0-9]+: ?(.*)$', 1) END AS message FROM m""")
def parse_log_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    line = F.when(k == 0, F.concat(F.lit("    "), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".go:"), F.col("p_size").cast("string"), F.lit(": got "), "p_type")).when(k == 1, F.concat(F.lit("--- FAIL: "), "p_name")).when(k == 2, "\tx.go:0: zero").otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", X.log_line(line).alias("l")).select("p_partkey", "l.ok", "l.file", "l.line", "l.message")


@query("SELECT p_partkey, p_name || chr(10) || '-' || p_type AS old FROM part")
def diff_old_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    diff = F.concat(F.lit("--- a/x.go\n+++ b/x.go\n@@ -1,2 +1 @@ f()\n-"), "p_name", F.lit("\n--"), "p_type", F.lit("\n+"), "p_brand", F.lit("\n-"), "p_brand", F.lit("\n"))
    return table(spark, sf_dir, "part").select("p_partkey", X.old_text(diff).alias("old"))


@query("SELECT doc_id, encode(left(text, 2048))::VARCHAR LIKE '%Code generated%' AND text LIKE '%DO NOT EDIT%' AS generated FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '// Code generated by x. DO NOT EDIT.' || text WHEN doc_id % 3 = 1 THEN repeat('x', 2040) || 'Code generated DO NOT EDIT' ELSE text END AS text FROM documents)".replace("encode(left(text, 2048))::VARCHAR LIKE '%Code generated%' AND text LIKE '%DO NOT EDIT%'", "doc_id % 3 = 0"))
def generated_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 3
    text = F.when(k == 0, F.concat(F.lit("// Code generated by x. DO NOT EDIT.\n"), "text")).when(k == 1, F.concat(F.repeat(F.lit("x"), 2040), F.lit("Code generated DO NOT EDIT"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", X.is_generated(text).alias("generated"))


@query("SELECT page_id, regexp_extract(url, '://([^?#]*)', 1) AS path FROM pages WHERE NOT list_has_any(string_split(regexp_extract(url, '://([^?#]*)', 1), '/'), ['en', 'de'])")
def skip_path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^?#]*)", 1).alias("path"))
    return pages.where(~select.skipped_path("path", directories=("en", "de")))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q, CASE WHEN l_linenumber = 3 THEN 'set' ELSE 'count' END AS mode FROM lineitem),
m AS (SELECT *, l_partkey > 0 AND l_suppkey > 0 AND l_linenumber > 0 AND q > 0 AND (l_suppkey > l_partkey OR (l_suppkey = l_partkey AND q >= l_linenumber)) AND (mode <> 'set' OR l_linenumber <= 1) AS ok FROM l)
SELECT l_orderkey, l_linenumber, ok, CASE WHEN ok THEN 'm/p' || l_linenumber || '.go' END AS file, CASE WHEN ok THEN l_partkey END AS start_line, CASE WHEN ok THEN l_suppkey END AS end_line, CASE WHEN ok THEN CAST(l_linenumber AS BIGINT) END AS count FROM m""")
def parse_coverage_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda c: F.col(c).cast("string")
    line = F.concat(F.lit("m/p"), s("l_linenumber"), F.lit(".go:"), s("l_partkey"), F.lit("."), s("l_linenumber"), F.lit(","), s("l_suppkey"), F.lit("."), F.col("l_quantity").cast("long").cast("string"), F.lit(" 1 "), s("l_linenumber"))
    mode = F.when(F.col("l_linenumber") == 3, "set").otherwise("count")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", parse_block(line, mode).alias("b"))
    return rows.select("l_orderkey", "l_linenumber", "b.ok", "b.file", "b.start_line", "b.end_line", "b.count")


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.results(spark, sf_dir).select(F.col("event_id").alias("seq"), F.concat(F.lit("R"), (F.col("user_id") % 10).cast("string")).alias("rule_id"), F.col("props").alias("description"), "verdict", F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".go")).alias("file"), (F.col("event_id") % 100 + 1).alias("start_line"))


@query(f"SELECT 'R' || user_id % 10 AS rule_id, arg_min(props, event_id) AS description FROM events WHERE {A.VERDICT_SQL} IN {A.ACTIONABLE_SQL} GROUP BY 1")
def sarif_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.rules(_findings(spark, sf_dir))


@query(f"""SELECT event_id AS seq, 'R' || user_id % 10 AS rule_id, CASE WHEN event_type = 'error' THEN 'warning' ELSE 'note' END AS level, 'u' || user_id || '.go' AS file, event_id % 100 + 1 AS start_line,
CASE event_type WHEN 'error' THEN 'No selected test noticed this change: ' WHEN 'view' THEN 'The tests ran out of time on this change: ' ELSE 'The tests gave no verdict on this change: ' END || props AS message
FROM events WHERE {A.VERDICT_SQL} IN {A.ACTIONABLE_SQL}""")
def sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.results(_findings(spark, sf_dir)).select("seq", "rule_id", "level", "file", "start_line", "message")


@query("""SELECT 'duplicate id' AS problem, l_orderkey || '/' || l_linenumber AS subject FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'bad verdict', event_id::VARCHAR FROM events WHERE event_type NOT IN ('click', 'view', 'error', 'signup')
UNION ALL SELECT 'bad span', p_partkey::VARCHAR FROM part WHERE p_size < 5
UNION ALL SELECT 'count differs', c_custkey::VARCHAR FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey WHERE coalesce(n, 0) <> 10""")
def integrity_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import validate as V

    duplicates = V.duplicates(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")
    domain = V.violations(table(spark, sf_dir, "events"), "event_id", "bad verdict", ~F.col("event_type").isin("click", "view", "error", "signup"))
    spans = V.violations(table(spark, sf_dir, "part"), "p_partkey", "bad span", F.col("p_size") < 5)
    counts = V.recount(table(spark, sf_dir, "customer").select("c_custkey", F.lit(10).alias("said")), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey", "said")
    return duplicates.unionByName(domain).unionByName(spans).unionByName(counts)


@query(f"WITH s AS (SELECT {A.COUNTS_SQL} FROM (SELECT {A.VERDICT_SQL} AS v FROM events)) SELECT *, {A.SCORE_SQL} AS score FROM s")
def stream_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(source).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return summarize_stream(stream.withColumn("verdict", A.mapped(F.col("event_type"), A.VERDICT_OF)))


@query()
def evidence_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "events").select("user_id", "event_id", (F.octet_length("props") + F.col("event_id") % 40).alias("size"))
    return E.evidence_budget(sized, stream="user_id", seq="event_id", size="size", max_events=20, max_bytes=400).select("user_id", "kept", "used", F.array_join(F.transform("seqs", lambda x: x.cast("string")), ",").alias("seqs"))


@query("""SELECT event_id AS id, 'u' || user_id || '.go' AS file, event_id % 50 + 1 + i AS line, NULL::VARCHAR AS error FROM events, unnest(range(0, event_id % 3)) AS t(i) WHERE event_id % 10 <> 0
UNION ALL SELECT event_id, NULL, NULL, 'a hunk ends too early' FROM events WHERE event_id % 10 = 0""")
def parse_unified_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".go"))
    n = F.col("event_id") % 3
    added = F.array_join(F.array_repeat(F.lit("+++ x\n"), n.cast("int")), "")
    count = F.when(F.col("event_id") % 10 == 0, n + 1).otherwise(n)
    text = F.concat(F.lit("diff --git a/"), file, F.lit(" b/"), file, F.lit("\nindex 1..2\n--- a/"), file, F.lit("\n+++ b/"), file, F.lit("\n@@ -1,0 +"), (F.col("event_id") % 50 + 1).cast("string"), F.lit(","), count.cast("string"), F.lit(" @@\n"), added)
    return parse_diffs(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), text.alias("diff")))


@query("SELECT conv_id, turn, md5(text || '!') AS after FROM conversations")
def unified_diff_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with a mark at its end, by way of a diff."""
    import hashlib

    def run(batches):
        for b in batches:
            out = []
            for text in b.column(2).to_pylist():
                raw = (text or "").encode()
                out.append(hashlib.md5(apply_unified(raw, unified_diff("t.go", raw, len(raw), len(raw), b"!"))).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], ["conv_id", "turn", "after"])

    bound_batches(spark)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").mapInArrow(run, "conv_id long, turn long, after string")


@query("""SELECT s.p_partkey || '.go' AS file, rule_id, n AS start_line, o AS original, r AS replacement
FROM part s, (VALUES ('BOUNDARY', 3, '<', '<='), ('BOOL-LITERAL', 4, 'true', 'false'), ('ARITHMETIC', 6, '+', '-')) AS m(rule_id, n, o, r)""")
def discover_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.discover import discover

    body = F.concat(F.lit("package p\nfunc f(a, b int) bool { // "), "p_name", F.lit("\n\tif a < "), F.col("p_size").cast("string"), F.lit(" {\n\t\treturn true\n\t}\n\treturn g(a + b)\n}\n"))
    sources = table(spark, sf_dir, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(".go")).alias("file"), body.alias("source"))
    return discover(sources, families=("boundary", "boolean", "arithmetic"), columns=("file", "rule_id", "start_line", "original", "replacement"))
