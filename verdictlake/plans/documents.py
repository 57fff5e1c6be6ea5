"""Queries on documents read and written, discovery by every rule, assembly and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import assemble, compare, discards, identity, select, spool, trees, verdicts
from ..sinks import findings
from ..sources import coverage_profile, lines, reports
from ..streaming.summary import classify_live, run_to_end
from . import analogues as A
from .analogues import table
from .records import SQL as RECORDS_SQL

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _s(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _text(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


# -- discovery ---------------------------------------------------------------------------------------------------

#: Lines of a source; {n} is the part's size and {k} its key.
_SOURCE = """package p
import "fmt"
const top = 9
func f{k}(a, b int, xs []int, t *T) (int, string, error) {
	ok := true
	ok = a < b
	if err := g(a); err != nil {
		return a - {n}, t.name, err
	}
	t.n = a
	t.xs[a]++
	h(a, b)
	mu.Lock()
	fmt.Println(a)
	if a > {n} && ok {
		t.set(a)
	}
	s := xs[a:b]
	s = xs[1:top]
	for {
		t.step()
	}
	for i := 0; i < b; i++ {
		t.put(i)
		if i > 3 { t.n = b }
	}
	for _, x := range xs {
		use(x)
	}
	go func() { t.n = b }()
	if a != b {
		return a < b
	}
	a += b
	ch := make(chan int, 4)
	select {
	case <-ch:
		use(s)
	case ch <- a:
		use(b)
	}
	switch a {
	case b:
		use(t)
	}
	if !ok || t.done {
		use("end")
	}
	if a == b {
		return a * b, "x", nil
	}
	return a, s, nil
}
"""
_EXPECTED = """
('LITERAL-INC', 3, '9', '10'), ('LITERAL-DEC', 3, '9', '8'), ('BOOL-LITERAL', 5, 'true', 'false'), ('BOUNDARY', 6, '<', '<='), ('RELATIONAL', 7, '!=', '=='), ('RET-ZERO', 8, 'a - {n}', '0'), ('RET-ZERO', 8, 't.name', '""'),
('ARITHMETIC', 8, '-', '+'), ('LITERAL-INC', 8, '{n}', '{n1}'), ('LITERAL-DEC', 8, '{n}', '{n0}'), ('ERR-SWALLOW', 8, 'err', 'nil'), ('STMT-DELETE-ASSIGN', 10, 't.n = a', ''), ('STMT-DELETE-ASSIGN', 11, 't.xs[a]++', ''), ('ASSIGN-INCDEC', 11, '++', '--'),
('STMT-DELETE-CALL', 12, 'h(a, b)', ''), ('COND-NEGATE', 15, 'a > {n} && ok', '!(a > {n} && ok)'), ('BOUNDARY', 15, '>', '>='), ('LITERAL-INC', 15, '{n}', '{n1}'), ('LITERAL-DEC', 15, '{n}', '{n0}'), ('CONN-SWAP', 15, '&&', '||'),
('BOOL-DROP-RIGHT', 15, 'a > {n} && ok', '(a > {n})'), ('BOOL-DROP-LEFT', 15, 'a > {n} && ok', '(ok)'), ('STMT-DELETE-CALL', 16, 't.set(a)', ''), ('SLICE-LOW', 18, 'a', 'a + 1'), ('SLICE-HIGH', 18, 'b', 'b - 1'), ('LITERAL-INC', 19, '1', '2'), ('LITERAL-DEC', 19, '1', '0'),
('LOOP-BREAK-FIRST', 21, 't.step()', 'break'), ('LITERAL-INC', 23, '0', '1'), ('LITERAL-DEC', 23, '0', '-1'), ('BOUNDARY', 23, '<', '<='), ('LOOP-COND-FALSE', 23, 'i < b', 'false'), ('BOUNDARY', 25, '>', '>='), ('LITERAL-INC', 25, '3', '4'), ('LITERAL-DEC', 25, '3', '2'),
('LOOP-BREAK-FIRST', 28, 'use(x)', 'break'), ('RELATIONAL', 31, '!=', '=='), ('BOUNDARY', 32, '<', '<='), ('ASSIGN-OP', 34, '+=', '-='), ('CHAN-UNBUFFER', 35, '4', '0'), ('LITERAL-INC', 35, '4', '5'), ('LITERAL-DEC', 35, '4', '3'),
('CHAN-SELECT-DROP-CASE', 37, 'case <-ch:' || chr(10) || chr(9) || chr(9) || 'use(s)', ''), ('CHAN-SELECT-DROP-CASE', 39, 'case ch <- a:' || chr(10) || chr(9) || chr(9) || 'use(b)', ''), ('STMT-DELETE-CALL', 38, 'use(s)', ''), ('STMT-DELETE-CALL', 40, 'use(b)', ''),
('SWITCH-DROP-CASE', 43, 'case b:' || chr(10) || chr(9) || chr(9) || 'use(t)', ''), ('STMT-DELETE-CALL', 44, 'use(t)', ''), ('BOOL-DROP-NOT', 46, '!ok', '(ok)'), ('BOOL-DROP-RIGHT', 46, '!ok || t.done', '(!ok)'), ('BOOL-DROP-LEFT', 46, '!ok || t.done', '(t.done)'),
('COND-NEGATE', 46, '!ok || t.done', '!(!ok || t.done)'), ('CONN-SWAP', 46, '||', '&&'), ('STMT-DELETE-CALL', 47, 'use("end")', ''), ('LITERAL-STRING-EMPTY', 47, '"end"', '""'), ('RELATIONAL', 49, '==', '!='), ('RET-ZERO', 50, 'a * b', '0'), ('ARITHMETIC', 50, '*', '/'), ('LITERAL-STRING-EMPTY', 50, '"x"', '""'),
('RET-ZERO', 52, 'a', '0'), ('RET-ZERO', 52, 's', '""')"""


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.replace(F.replace(F.lit(_SOURCE), F.lit("{n}"), _s("p_size")), F.lit("{k}"), _s("p_partkey"))
    from ..functions.discover import spread

    parts = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"))  # before the sources are made, as these are longer
    return parts.select(_text(_s("p_partkey"), ".go").alias("file"), body.alias("source"), "p_partkey", "p_size")


@query(f"""WITH m(rule_id, n, o, r) AS (VALUES {_EXPECTED}), f AS (SELECT p_partkey || '.go' AS file, rule_id, n AS start_line, o, r, p_size FROM part, m)
SELECT file, rule_id, start_line, replace(o, '{{n}}', p_size::VARCHAR) AS original, replace(replace(replace(r, '{{n1}}', (p_size + 1)::VARCHAR), '{{n0}}', (p_size - 1)::VARCHAR), '{{n}}', p_size::VARCHAR) AS replacement,
 CASE WHEN rule_id = 'BOOL-LITERAL' THEN 'the next statement sets ok without reading it' WHEN start_line = 32 THEN 'the condition a != b around it already says that both sides differ' END AS equivalent_reason FROM f""")
def discover_every_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source that every rule and guard has a part in: locks, logs, loops that a change could keep from ending, goroutines and constants are left alone."""
    from ..functions.discover import FAMILIES, discover

    return discover(_sources(spark, sf_dir), families=FAMILIES, columns=("file", "rule_id", "start_line", "original", "replacement", "equivalent_reason"))


@query("""SELECT c_custkey || '.go' AS file, c_custkey % 4 AS kind, CASE c_custkey % 4 WHEN 0 THEN 'if a > 1 { b() }' WHEN 2 THEN 'f(x)' ELSE '' END AS found FROM customer""")
def discover_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four kinds of functions: one whose condition and call may be changed, and three that goto, self-recursion or an own ``true`` rule out."""
    from ..functions.discover import discover

    k = F.col("c_custkey") % 4
    body = (
        F.when(k == 0, "func f(a int) {\n\tif a > 1 { b() }\n}\n").when(k == 1, "func f(a int) {\nagain:\n\tif a > 1 { goto again }\n}\n").when(k == 2, "func f(x int) {\n\tif x > 1 {\n\t\tf(x)\n\t}\n}\n").otherwise("func f(true int) int {\n\treturn true\n}\n")
    )
    sources = table(spark, sf_dir, "customer").select(_text(_s("c_custkey"), ".go").alias("file"), _text("package p\n", body).alias("source"), k.alias("kind"))
    found = discover(sources, families=("condition", "statement", "boolean"), columns=("file", "rule_id")).groupBy("file").agg(F.array_join(F.sort_array(F.collect_list("rule_id")), ",").alias("rules"))
    said = F.when(F.col("rules") == "COND-NEGATE,STMT-DELETE-CALL", "if a > 1 { b() }").when(F.col("rules") == "STMT-DELETE-CALL", "f(x)").otherwise(F.coalesce("rules", F.lit("")))
    return sources.select("file", "kind").join(found, "file", "left").select("file", "kind", said.alias("found"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 0 WHEN 3 THEN 2 ELSE 2 END AS sites, p_partkey % 5 IN (0, 1) AND p_partkey % 7 <> 0 AS always_discarded FROM part""")
def discarded_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of five packages each: results dropped by plain calls, by blanks and deferred calls, never called, read once, and exported; a directive names every seventh."""
    k, name = F.col("p_partkey") % 5, _text(F.when(F.col("p_partkey") % 5 == 4, "F").otherwise("f"), _s("p_partkey"))
    call = F.when(k == 0, _text("\t", name, "(1)\n\t", name, "(2)\n")).when(k == 1, _text("\t_ = ", name, "(1)\n\tdefer ", name, "(2)\n\t_, _ = ", name, "(3)\n")).when(k == 2, "").when(k == 3, _text("\t", name, "(1)\n\tx := ", name, "(2)\n")).otherwise(_text("\t", name, "(1)\n\t", name, "(2)\n"))
    directive = F.when(F.col("p_partkey") % 7 == 0, _text("//go:linkname ", name, " other.sym\n")).otherwise("")
    sources = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), _s("p_partkey").alias("package"), _text("package p\n", directive, "func ", name, "(a int) int { return a }\nfunc g() {\n", call, "}\n").alias("source"))
    return discards.discarded(sources.select("p_partkey", "package", "name"), discards.mentions(sources)).select("p_partkey", "sites", "always_discarded")


# -- documents read ----------------------------------------------------------------------------------------------


@query(f"""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ordinal, {A.VERDICT_SQL} AS verdict FROM events),
t AS (SELECT user_id, user_id % 3 AS k FROM r GROUP BY user_id)
SELECT r.user_id::VARCHAR AS path, ordinal, 'M-' || event_id AS id, 'u' || r.user_id || '.go' AS file, event_id % 50 + 1 AS start_line, verdict, NULL::VARCHAR AS error FROM r JOIN t ON r.user_id = t.user_id WHERE k = 0
UNION ALL SELECT user_id::VARCHAR, NULL, NULL, NULL, NULL, NULL, CASE k WHEN 1 THEN 'summary.killed is no whole number' ELSE 'counts disagree with results' END FROM t WHERE k <> 0""")
def report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report document for each user, checked and taken apart: a third is sound, in a third a count is written as a fraction, in a third it is wrong."""
    rows = A.results(spark, sf_dir)
    line = F.col("event_id") % 50 + 1
    span = F.struct(_text("u", _s("user_id"), ".go").alias("file"), F.lit(0).alias("start_byte"), F.lit(1).alias("end_byte"), line.alias("start_line"), F.lit(1).alias("start_column"), line.alias("end_line"), F.lit(2).alias("end_column"))
    filled = lambda *names: [F.lit("x").alias(n) for n in names]
    mutation = F.struct(_text("M-", _s("event_id")).alias("id"), span.alias("span"), *filled("operator", "rule_id", "original", "replacement", "description", "suggestion", "diff"))
    result = F.struct("event_id", F.struct(mutation.alias("mutation"), F.col("verdict"), F.struct(F.lit("d").alias("id"), span.alias("location"), F.lit("s").alias("statement")).alias("diagnostic")).alias("r"))
    grouped = rows.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(result)), lambda x: x["r"]).alias("results")).join(verdicts.summarize(rows, "user_id"), "user_id")
    k, n = F.col("user_id") % 3, F.col("generated")
    counts = [F.when((k == 2) & F.lit(c == "killed"), F.col(c) + 1).otherwise(F.col(c)).alias(c) for c in verdicts.COUNTS]
    report = F.struct(
        F.lit("v").alias("schema_version"), F.lit("1").alias("tool_version"), F.lit("1").alias("go_version"), F.lit("2024-01-02T03:04:05Z").alias("generated_at"), F.lit(True).alias("complete"), F.array(F.lit("./...")).alias("patterns"),
        F.struct(F.lit(1).alias("max")).alias("effective_config"), F.struct(n.alias("discovered_before_bound"), n.alias("retained_after_bound"), n.alias("completed_mutants")).alias("bounds"), F.array(F.lit("s")).alias("semantics"),
        F.struct(*counts, "score", "score_text").alias("summary"), F.col("results"), F.struct(*(F.lit(0).alias(t) for t in reports.NESTED["timing"])).alias("timing"),
    )
    text = F.to_json(report)
    text = F.when(k == 1, F.regexp_replace(text, r'"killed":(\d+)', r'"killed":$1.0')).otherwise(text)
    parsed = reports.parse_reports(grouped.select(_s("user_id").alias("path"), text.alias("text")), "v")
    return reports.results_of(parsed, "error").select("path", "ordinal", "id", "file", "start_line", "verdict", "error")


@query("""SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS line_no, o_orderkey % 9 <> 0 AS ok, CASE WHEN o_orderkey % 9 <> 0 THEN 'run ' || o_orderkey END AS label,
CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END AS score, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey % 100 END AS killed FROM orders""")
def history_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history file for each customer, every ninth line of it no entry; its last line has no end, and blank lines count but are passed over."""
    good = F.to_json(F.struct(_text("run ", _s("o_orderkey")).alias("label"), F.col("o_totalprice").cast("double").alias("score"), (F.col("o_orderkey") % 100).alias("killed"), F.array(F.lit("./...")).alias("patterns")))
    line = F.when(F.col("o_orderkey") % 9 == 0, "[1, 2]").otherwise(good)
    files = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    got = lines.parse_history(files, key="o_custkey")
    fit = lambda c: F.when(F.col("ok"), F.col(c)).alias(c)
    return got.select("o_custkey", "line_no", "ok", fit("label"), fit("score"), fit("killed"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
b AS (SELECT *, l_partkey > 0 AND l_suppkey > 0 AND l_linenumber > 0 AND q > 0 AND (l_suppkey > l_partkey OR (l_suppkey = l_partkey AND q >= l_linenumber)) AS ok FROM l)
SELECT l_orderkey, ok, CASE WHEN ok THEN 'p' || l_linenumber || '.go' END AS file, CASE WHEN ok THEN l_partkey END AS start_line, CASE WHEN ok THEN l_suppkey END AS end_line FROM b
UNION ALL SELECT o_orderkey, false, NULL, NULL, NULL FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def coverage_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coverage profile for each order, its paths made relative to the root; an order without lines gives an empty, and so bad, profile."""
    row = _text("/src/./m//p", _s("l_linenumber"), ".go:", _s("l_partkey"), ".", _s("l_linenumber"), ",", _s("l_suppkey"), ".", F.col("l_quantity").cast("long").cast("string"), " 1 2")
    files = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(_text("mode: count\n", F.array_join(F.sort_array(F.collect_list(row)), "\n"), "\n").alias("text"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    whole = orders.join(files, "l_orderkey", "full_outer").withColumn("text", F.coalesce("text", F.lit("")))
    return coverage_profile.parse_profiles(whole, "/src/m", profile="l_orderkey").select("l_orderkey", "ok", "file", "start_line", "end_line")


@query("""SELECT ps.s_nationkey, 'm/s' || s_suppkey AS package, 'a' || s_suppkey || '.go,b.go' AS files, s_suppkey % 2 = 0 AS tested FROM supplier AS ps""")
def package_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream of package objects for each nation, as a listing prints them: one after another, over several lines."""
    one = F.to_json(F.struct(_text("m/s", _s("s_suppkey")).alias("ImportPath"), F.array(_text("a", _s("s_suppkey"), ".go"), F.lit("b.go")).alias("GoFiles"), F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("a_test.go"))).alias("TestGoFiles")), {"pretty": "true"})
    files = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_join(F.collect_list(one), "\n").alias("text"))
    got = lines.parse_packages(files.withColumn("path", _s("s_nationkey")))
    return got.select(F.col("path").cast("int").alias("s_nationkey"), F.col("ImportPath").alias("package"), F.array_join("GoFiles", ",").alias("files"), assemble.has_own_tests(F.col("TestGoFiles"), F.col("XTestGoFiles")).alias("tested"))


@query(f"""SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, CASE WHEN event_id % 8 = 0 THEN '' ELSE {A.ACTION_SQL} END AS "Action", CASE WHEN event_id % 8 = 0 THEN '' ELSE 't' || event_id END AS "Test", event_id % 8 = 0 AS lost FROM events""")
def event_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The output of a test process for each user; every eighth line is no JSON object and marks its stream as incomplete."""
    good = F.to_json(F.struct(A.mapped(F.col("event_type"), A.ACTION_OF).alias("Action"), _text("t", _s("event_id")).alias("Test")))
    line = F.when(F.col("event_id") % 8 == 0, "FAIL {").otherwise(good)
    files = table(spark, sf_dir, "events").groupBy("user_id").agg(_text(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", line.alias("l")))), lambda x: x["l"]), "\n"), "\n").alias("text"))
    return lines.parse_events(files, key="user_id").select("user_id", "seq", "Action", "Test", "lost")


@query("""SELECT p_brand, CASE p_partkey % 4 WHEN 0 THEN 'Test' WHEN 1 THEN 'Example' WHEN 2 THEN 'Fuzz' END || p_partkey AS name, p_partkey % 4 <> 0 AS always FROM part WHERE p_partkey % 4 <> 3""")
def test_unit_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What test binaries list, a text for each brand: tests, examples and fuzz targets, the latter two to be run always; other lines are none."""
    k = F.col("p_partkey") % 4
    line = F.when(k == 0, _text("Test", _s("p_partkey"))).when(k == 1, _text("Example", _s("p_partkey"))).when(k == 2, _text("Fuzz", _s("p_partkey"))).otherwise("ok  \tm\t0.1s")
    files = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.collect_list(line), "\n").alias("text"))
    return lines.test_units(files, key="p_brand")


# -- identities, texts -------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, sha256('{"version":"verdictlake.result/1","mutation":"' || o_orderkey || '","tests":' || CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE '"' || o_orderstatus || '"' END || '}') AS key,
'go1.' || o_orderkey % 5 || '|linux|' || CASE WHEN o_orderkey % 2 = 0 THEN 'amd64' ELSE '' END AS toolchain FROM orders""")
def result_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"mutation": _s("o_orderkey"), "tests": F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus"))}
    tool = assemble.toolchain_key(_text("go1.", _s(F.col("o_orderkey") % 5)), F.lit("linux"), F.when(F.col("o_orderkey") % 2 == 0, "amd64"))
    return table(spark, sf_dir, "orders").select("o_orderkey", identity.result_key(fields).alias("key"), tool.alias("toolchain"))


@query("""WITH d AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '-tags x -modfile=y' WHEN 1 THEN '-overlay z' WHEN 2 THEN '-modfiles=q -x-toolexec' ELSE '' END AS flags, p_name || ', ' || p_type || ',,' AS names FROM part)
SELECT p_partkey, p_partkey % 4 < 2 AS untracked, array_to_string([y FOR y IN [trim(x) FOR x IN string_split(names, ',')] IF y <> ''], '|') AS parts,
CASE WHEN p_partkey % 3 = 0 THEN 'go test -count=1 -timeout 30s -run ^T$ ./...' ELSE 'go test -count=1 -timeout 30s ./...' END AS command,
CASE WHEN length(names) > 20 THEN left(names, 20) || '...' ELSE names END AS clipped, 'T' || p_size AS failing FROM d JOIN part USING (p_partkey)""")
def command_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    flags = F.when(k == 0, "-tags x -modfile=y").when(k == 1, "-overlay z").when(k == 2, "-modfiles=q -x-toolexec").otherwise("")
    names = _text(F.col("p_name"), ", ", F.col("p_type"), ",,")
    command = assemble.test_command(F.lit("30s"), F.when(F.col("p_partkey") % 3 == 0, "^T$"), F.array(F.lit("./...")))
    output = _text("x\n    --- FAIL: T", _s("p_size"), " (0.0s)\n--- PASS: U\n--- FAIL: T", _s("p_size"), "\n")
    return table(spark, sf_dir, "part").select(
        "p_partkey", assemble.untracked_flags(flags).alias("untracked"), F.array_join(X.split_comma(names), "|").alias("parts"), F.array_join(command, " ").alias("command"),
        X.clip_statement(names, 20).alias("clipped"), F.array_join(X.failing_tests(output), ",").alias("failing"),
    )


@query("""WITH t AS (SELECT c_custkey, c_name AS err, repeat('é', CAST(c_custkey % 40 AS BIGINT)) AS shown FROM customer), n AS (SELECT *, least(CAST(c_custkey % 40 AS BIGINT), (60 - strlen(err)) // 2) AS m, strlen(err) + 2 * (c_custkey % 40) AS total FROM t)
SELECT c_custkey, err || repeat('é', m) || CASE WHEN total > 60 THEN chr(10) || '... output cut (' || total || ' bytes seen)' ELSE '' END AS output FROM n""")
def diagnostic_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty bytes of error and output together, never half a character."""
    shown = F.repeat(F.lit("é"), (F.col("c_custkey") % 40).cast("int"))
    total = (F.octet_length("c_name") + F.octet_length(shown)).cast("long")
    return table(spark, sf_dir, "customer").select("c_custkey", assemble.diagnostic_output(F.col("c_name"), shown, total=total, incomplete=F.lit(False), limit=60).alias("output"))


# -- assembly, gates, findings -----------------------------------------------------------------------------------


@query(f"""WITH e AS (SELECT event_id, props, CASE WHEN event_id % 6 = 0 THEN 'EQUIVALENT' ELSE {A.VERDICT_SQL} END AS verdict FROM events)
SELECT event_id, verdict, 'MUT-' || verdict AS diagnostic_id, CASE WHEN verdict = 'EQUIVALENT' THEN 'equivalent: proof ' || event_id ELSE lower(verdict) || ': ' || props END AS statement, CASE WHEN verdict = 'SURVIVED' THEN 'try ' || event_id ELSE '' END AS suggestion,
CASE WHEN verdict = 'EQUIVALENT' THEN 1 ELSE 2 END AS assumed, verdict <> 'EQUIVALENT' AS needs_run FROM e""")
def diagnosed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    rows = A.results(spark, sf_dir).select("event_id", "verdict", F.col("props").alias("description"), _text("try ", _s(i)).alias("suggestion"), F.when(i % 6 == 0, _text("proof ", _s(i))).alias("equivalent_reason"))
    run = assemble.to_run(rows).select("event_id", F.lit(True).alias("needs_run"))
    made = assemble.diagnose(rows).join(run, "event_id", "left")
    return made.select("event_id", "verdict", "diagnostic_id", "statement", "suggestion", F.size("assumptions").alias("assumed"), F.coalesce("needs_run", F.lit(False)).alias("needs_run"))


@query(f"""SELECT event_id, '{{"source_diff":"d","exit_code":' || event_id % 3 || CASE WHEN event_id % 4 = 0 THEN ',"tests":["T' || event_id || '"]' ELSE '' END || CASE WHEN event_id % 5 = 0 THEN ',"output_truncated":true' ELSE '' END
|| CASE WHEN {A.VERDICT_SQL} <> 'SURVIVED' AND event_id % 2 = 0 THEN ',"output":"o"' ELSE '' END || CASE WHEN event_id % 7 = 0 THEN ',"covered":' || (event_id % 14 = 0)::VARCHAR ELSE '' END || '}}' AS evidence FROM events""")
def result_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, none = F.col("event_id"), F.array().cast("array<string>")
    made = assemble.evidence(
        diff=F.lit("d"), exit_code=i % 3, tests=F.when(i % 4 == 0, F.array(_text("T", _s(i)))).otherwise(none), assertions=none, panics=F.lit(None).cast("array<string>"), truncated=i % 5 == 0,
        output=F.when(i % 2 == 0, "o").otherwise(""), verdict=F.col("verdict"), covered=i % 14 == 0, coverage_known=i % 7 == 0,
    )
    return A.results(spark, sf_dir).select("event_id", made.alias("evidence"))


@query(f"""WITH r AS (SELECT user_id AS run, {A.VERDICT_SQL} AS v FROM events WHERE user_id % 5 <> 0), s AS (SELECT run, {A.COUNTS_SQL} FROM r GROUP BY run), p AS (SELECT user_id AS run, count(*) AS n FROM events GROUP BY 1),
j AS (SELECT p.run, p.n + p.run % 2 AS kept, s.* EXCLUDE (run) FROM p LEFT JOIN s ON p.run = s.run)
SELECT run, coalesce(generated, 0) = kept AS complete, kept + 3 AS discovered_before_bound, kept AS retained_after_bound, coalesce(generated, 0) AS completed_mutants,
coalesce(generated, 0) AS generated, coalesce(killed, 0) AS killed, coalesce(survived, 0) AS survived, coalesce(invalid, 0) AS invalid, coalesce(timeout, 0) AS timeout, coalesce(unknown, 0) AS unknown, coalesce(unsupported, 0) AS unsupported, coalesce(equivalent, 0) AS equivalent,
CASE WHEN killed + survived > 0 THEN 100.0::DOUBLE * killed / (killed + survived) ELSE 0.0::DOUBLE END AS score FROM j""")
def report_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.results(spark, sf_dir).withColumnRenamed("user_id", "run")
    kept = rows.groupBy("run").agg((F.count("*") + F.col("run") % 2).alias("retained")).withColumn("discovered", F.col("retained") + 3)
    return assemble.report_headers(rows.where("run % 5 <> 0"), kept)


@query(f"""WITH {A.RUNS_SQL}, {A.COMPARED_SQL} SELECT user_id % 50 AS team, count(*) FILTER (WHERE bucket = 'new_survivors') AS new_survivors, CASE WHEN count(*) FILTER (WHERE bucket = 'new_survivors') > 0 THEN 10 ELSE 0 END AS exit_code FROM z GROUP BY 1""")
def survivor_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .core import Q as CORE

    return assemble.gates(CORE["report_compare"](spark, sf_dir).withColumn("team", F.col("user_id") % 50), "team")


@query("""WITH p AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ordinal, event_id % 11 <> 0 AS done FROM events), g AS (SELECT run, count(*) AS n, min(ordinal) AS first, min(ordinal) FILTER (WHERE NOT done) AS gap FROM p GROUP BY run)
SELECT run, coalesce(gap - first, n) AS committed, gap IS NULL AS complete FROM g""")
def committed_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each interrupted run got without a gap."""
    ordinal = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), ordinal.alias("ordinal"), (F.col("event_id") % 11 != 0).alias("done"))
    return assemble.contiguous(rows.where("done"), rows)


@query("""SELECT o_custkey AS run, count(*) AS failures, arg_min('disk ' || o_orderkey, o_orderkey) AS first_error FROM orders WHERE o_orderkey % 6 = 0 GROUP BY 1""")
def cache_write_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 6 == 0, _text("disk ", _s("o_orderkey"))).alias("error"))
    return assemble.write_failures(rows)


@query("""WITH o AS (SELECT o_custkey * 0 + o_orderkey % 1000 AS ordinal FROM orders), n AS (SELECT ordinal, count(*) AS n FROM o GROUP BY 1)
SELECT CASE WHEN ordinal >= 900 THEN 'extra' ELSE 'repeated' END AS problem, ordinal, n FROM n WHERE ordinal >= 900 OR n > 1""")
def spool_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spool.spool_problems(table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 1000).alias("ordinal")), 900)


@query(f"""WITH e AS (SELECT event_id AS seq, {A.VERDICT_SQL} AS v, 'a:' || user_id || ',%.go' AS file, event_id % 9 + 1 AS line, props FROM events)
SELECT seq, '::' || CASE WHEN v = 'SURVIVED' THEN 'warning' ELSE 'notice' END || ' file=' || replace(replace(replace(file, '%', '%25'), ':', '%3A'), ',', '%2C') || ',line=' || line || ',title=R::'
|| CASE v WHEN 'SURVIVED' THEN 'No selected test noticed this change: ' WHEN 'TIMEOUT' THEN 'The tests ran out of time on this change: ' ELSE 'The tests gave no verdict on this change: ' END || replace(replace(replace(props, '%', '%25'), chr(13), '%0D'), chr(10), '%0A') AS command
FROM e WHERE v IN {A.ACTIONABLE_SQL}""")
def annotation_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.results(spark, sf_dir).select(F.col("event_id").alias("seq"), "verdict", _text("a:", _s("user_id"), ",%.go").alias("file"), (F.col("event_id") % 9 + 1).alias("start_line"), F.lit("R").alias("rule_id"), F.col("props").alias("description"))
    return findings.annotations(rows)


@query("""WITH h AS (SELECT 'd/' || p_partkey AS rel, p_size AS kind, p_brand AS mode, p_type AS content FROM part WHERE p_partkey % 10 <> 0),
s AS (SELECT 'd/' || p_partkey AS rel, p_size + (p_partkey % 11 = 0)::INT AS kind, p_brand || CASE WHEN p_partkey % 13 = 0 THEN 'x' ELSE '' END AS mode, CASE WHEN p_partkey % 17 = 0 THEN p_name ELSE p_type END AS content FROM part WHERE p_partkey % 9 <> 0)
SELECT rel, problem FROM (SELECT coalesce(h.rel, s.rel) AS rel, CASE WHEN s.rel IS NULL THEN 'missing' WHEN h.rel IS NULL THEN 'extra' WHEN h.kind <> s.kind THEN 'kind' WHEN h.mode <> s.mode THEN 'mode' WHEN h.content <> s.content THEN 'content' END AS problem FROM h FULL OUTER JOIN s ON h.rel = s.rel) WHERE problem IS NOT NULL""")
def snapshot_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    rel = _text("d/", _s("p_partkey"))
    host = p.where(k % 10 != 0).select(rel.alias("rel"), F.col("p_size").alias("kind"), F.col("p_brand").alias("mode"), F.col("p_type").alias("content"))
    copy = p.where(k % 9 != 0).select(rel.alias("rel"), (F.col("p_size") + F.when(k % 11 == 0, 1).otherwise(0)).alias("kind"), _text(F.col("p_brand"), F.when(k % 13 == 0, "x").otherwise("")).alias("mode"), F.when(k % 17 == 0, F.col("p_name")).otherwise(F.col("p_type")).alias("content"))
    return trees.tree_differences(host, copy)


@query("""SELECT p_brand AS tree, count(*) AS entries, true AS agrees FROM part GROUP BY 1""")
def tree_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest for each brand's parts as a tree, taken twice in other orders: both agree, and a changed content gives another."""
    p = table(spark, sf_dir, "part")
    rows = p.select(F.col("p_brand").alias("tree"), _text("d/", _s("p_partkey")).alias("rel"), F.lit("file").alias("kind"), F.lit("644").alias("mode"), F.col("p_name").alias("content"))
    one = trees.tree_digest(rows).withColumnRenamed("digest", "a")
    two = trees.tree_digest(rows.orderBy(F.desc("rel"))).withColumnRenamed("digest", "b")
    other = trees.tree_digest(rows.withColumn("content", _text(F.col("content"), "!"))).withColumnRenamed("digest", "c")
    n = rows.groupBy("tree").agg(F.count("*").alias("entries"))
    return n.join(one, "tree").join(two, "tree").join(other, "tree").select("tree", "entries", ((F.col("a") == F.col("b")) & (F.col("a") != F.col("c"))).alias("agrees"))


@query("""SELECT p_partkey, row_number() OVER (ORDER BY p_brand, p_size, p_partkey) AS place FROM part QUALIFY place <= 100""")
def ordered_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred in discovery order, numbered: a top-k, then a window over its rows."""
    kept = select.discovery_order(table(spark, sf_dir, "part"), ("p_brand", "p_size", "p_partkey")).limit(100)
    return kept.select("p_partkey", F.row_number().over(Window.orderBy("p_brand", "p_size", "p_partkey")).alias("place"))


@query("""SELECT field, baseline, current FROM (VALUES ('kind', '{"v":"a"}', '{"v":"b"}')) AS t(field, baseline, current)""")
def header_incompatibilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "region").agg(F.count("*").alias("n"), F.max("r_name").alias("name"))
    return compare.incompatibilities(n.withColumn("kind", F.lit("a")), n.withColumn("kind", F.lit("b")), ("n", "name", "kind"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, strlen(props) + event_id % 40 AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
w AS (SELECT user_id, 0::BIGINT AS r, 0::BIGINT AS kept, 0::BIGINT AS used, ''::VARCHAR AS seqs FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT w.user_id, e.r, w.kept + f::BIGINT, w.used + CASE WHEN f THEN e.n ELSE 0 END, w.seqs || CASE WHEN f THEN CASE WHEN w.kept > 0 THEN ',' ELSE '' END || e.event_id ELSE '' END
FROM w JOIN (SELECT * FROM e) e ON e.user_id = w.user_id AND e.r = w.r + 1, LATERAL (SELECT w.kept < 20 AND w.used + e.n <= 400 AS f))
SELECT user_id, arg_max(kept, r) AS kept, CAST(arg_max(used, r) AS BIGINT) AS used, arg_max(seqs, r) AS seqs FROM w GROUP BY user_id""")
def evidence_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .records import Q as RECORDS

    return RECORDS["evidence_budget"](spark, sf_dir)


@query(RECORDS_SQL["classify_stream"].replace("user_id::VARCHAR || '/' || strftime(ts, '%d')", "user_id::VARCHAR"))
def live_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of each user's events as one live stream, by state kept between batches; every batch of a stream says that it may end."""
    source = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(source).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    i = F.col("event_id")
    test = F.when(F.col("event_type") == "click", "").otherwise(_text("t", _s(i % 4)))
    row = lambda action: F.struct(_s("user_id").alias("stream_id"), i.alias("seq"), _text("p", _s(i % 3)).alias("Package"), test.alias("Test"), action.alias("Action"), (i % 2 == 0).alias("broken"), (F.col("value") < 2).alias("lost"))
    events = stream.select(F.explode(F.array(row(A.mapped(F.col("event_type"), A.ACTION_OF)), row(F.lit("end")))).alias("e")).select("e.*")
    return run_to_end(classify_live(events))
