"""Queries on verdicts, comparison, coverage, scopes, selection and identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import compare, coverage, identity, scopes, select, verdicts
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


@query(f"WITH s AS (SELECT {A.COUNTS_SQL} FROM (SELECT {A.VERDICT_SQL} AS v FROM events)), t AS (SELECT *, {A.SCORE_SQL} AS score FROM s) SELECT *, {A.TEXT_SQL} AS score_text FROM t")
def verdict_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.summarize(A.results(spark, sf_dir))


@query(f"WITH s AS (SELECT day, {A.COUNTS_SQL} FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, {A.VERDICT_SQL} AS v FROM events) GROUP BY day), t AS (SELECT *, {A.SCORE_SQL} AS score FROM s) SELECT *, {A.TEXT_SQL} AS score_text FROM t")
def verdict_summary_per_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.summarize(A.results(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd")), "day")


@query(f"""WITH s AS (SELECT day, {A.COUNTS_SQL} FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, {A.VERDICT_SQL} AS v FROM events) GROUP BY day),
t AS (SELECT 'PR ' || day AS label, {A.SCORE_SQL} AS score FROM s), u AS (SELECT *, row_number() OVER (ORDER BY label) AS line_no FROM t)
SELECT line_no, label, score, rpad(label, CAST((SELECT max(strlen(label)) FROM u) AS INTEGER), ' ') || '  ' || printf('%.1f', score) || '%' AS line FROM u""")
def trend_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sinks.history import trend_lines

    days = verdicts.summarize(A.results(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd")), "day", with_text=False)
    # a history has one short row for each recorded report
    rows = days.select(F.concat(F.lit("PR "), "day").alias("label"), "score")
    rows = rows.withColumn("line_no", F.row_number().over(Window.orderBy("label")).cast("long"))
    return trend_lines(rows).select("line_no", "label", "score", "line")


@query(f"WITH {A.RUNS_SQL}, {A.COMPARED_SQL} SELECT id, bv AS baseline_verdict, cv AS current_verdict, bucket, user_id FROM z")
def report_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.compare_runs(A.baseline(spark, sf_dir), A.current(spark, sf_dir), carry=("user_id",))


@query(f"WITH {A.RUNS_SQL}, {A.COMPARED_SQL} SELECT bucket, count(*) AS n FROM z GROUP BY bucket")
def compare_bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.bucket_counts(compare.compare_runs(A.baseline(spark, sf_dir), A.current(spark, sf_dir)))


@query(f"WITH {A.RUNS_SQL} SELECT id, verdict, user_id FROM b WHERE id NOT IN (SELECT id FROM c)")
def compare_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.removed(A.baseline(spark, sf_dir), A.current(spark, sf_dir))


@query(f"WITH {A.RUNS_SQL} SELECT id, verdict, user_id FROM c WHERE id NOT IN (SELECT id FROM b)")
def compare_brand_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.brand_new(A.baseline(spark, sf_dir), A.current(spark, sf_dir))


@query("""WITH d AS (SELECT doc_id AS id, lang, n_chars, md5(text) AS body, source AS verdict, doc_id % 2 AS side FROM documents),
g AS (SELECT side, lang, n_chars, body, count(*) AS n, min(id) AS id, min(verdict) AS verdict FROM d GROUP BY ALL HAVING count(*) = 1)
SELECT a.id AS removed_id, b.id AS new_id, a.lang, a.n_chars, a.body, a.id AS old_line, b.id AS new_line, a.verdict <> b.verdict AS verdict_changed
FROM g a JOIN g b ON a.lang = b.lang AND a.n_chars = b.n_chars AND a.body = b.body WHERE a.side = 0 AND b.side = 1""")
def shift_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "n_chars", F.md5("text").alias("body"), F.col("source").alias("verdict"))
    return compare.shift_candidates(docs.where("id % 2 = 0"), docs.where("id % 2 = 1"), fingerprint=("lang", "n_chars", "body"), line="id")


@query(f"""WITH {A.RUNS_SQL}, {A.COMPARED_SQL} SELECT id, bv AS baseline_verdict, cv AS current_verdict, bucket,
CASE WHEN cv IS NULL THEN 'not_analyzed' WHEN bv IS NULL THEN CASE WHEN ca THEN 'new_survivors' ELSE 'unchanged' END WHEN bv <> cv THEN 'unverified_changes' ELSE 'unchanged' END AS exploratory FROM z""")
def compare_exploratory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.explore(compare.compare_runs(A.baseline(spark, sf_dir), A.current(spark, sf_dir)))


_SPANS = "SELECT doc_id AS id, source AS file, doc_id AS start_line, doc_id + n_chars % 50 AS end_line FROM documents"
_BLOCKS = "SELECT source AS file, l.doc_id AS start_line, l.doc_id + 5 AS end_line, quality AS count FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE source NOT IN ('src0', 'src1', 'src2', 'src3')"


@query(f"""WITH s AS ({_SPANS}), k AS ({_BLOCKS})
SELECT s.id, s.file, s.start_line, s.end_line, CASE WHEN s.file NOT IN (SELECT file FROM k) THEN NULL
 ELSE EXISTS (SELECT 1 FROM k WHERE k.count > 0 AND k.file = s.file AND k.start_line <= s.end_line AND k.end_line >= s.start_line) END AS covered FROM s""")
def coverage_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    spans = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("file"), F.col("doc_id").alias("start_line"), (F.col("doc_id") + F.col("n_chars") % 50).alias("end_line"))
    blocks = table(spark, sf_dir, "labels").join(docs.select("doc_id", "source"), "doc_id").where(~F.col("source").isin("src0", "src1", "src2", "src3"))
    blocks = blocks.select(F.col("source").alias("file"), F.col("doc_id").alias("start_line"), (F.col("doc_id") + 5).alias("end_line"), F.col("quality").alias("count"))
    return coverage.annotate(spans, blocks, grid=True)


@query("""WITH f AS (SELECT DISTINCT regexp_extract(url, '://([^?#]*)', 1) AS file FROM pages), p AS (SELECT file, string_split(file, '/') AS parts FROM f),
e AS (SELECT file, array_to_string(parts[i:], '/') AS suffix FROM (SELECT file, parts, unnest(range(1, len(parts) + 1)) AS i FROM p))
SELECT suffix, min(file) AS file FROM e GROUP BY suffix HAVING count(DISTINCT file) = 1""")
def suffix_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.suffix_index(table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^?#]*)", 1).alias("file")))


@query("""WITH c AS (SELECT c_custkey, c_nationkey || '/' || c_mktsegment AS span, c_name FROM customer),
o AS (SELECT o_custkey, bool_or(o_orderdate >= TIMESTAMP '1998-01-01') AS hit FROM orders GROUP BY o_custkey),
g AS (SELECT span, bool_and(o_custkey IS NOT NULL) AS known, string_agg(DISTINCT c_name, ',' ORDER BY c_name) FILTER (WHERE hit) AS names FROM c LEFT JOIN o ON c_custkey = o_custkey GROUP BY span)
SELECT span, known, CASE WHEN known THEN coalesce(names, '') END AS tests FROM g""")
def covering_tests_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select(F.concat_ws("/", "c_nationkey", "c_mktsegment").alias("span"), F.col("c_custkey").alias("package"), F.col("c_name").alias("test"))
    hits = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("package")).agg(F.bool_or(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).alias("covered"))
    return coverage.covering_tests_strict(people.select("span", "package"), people.join(hits, "package"))


@query("""WITH c AS (SELECT c_nationkey || '/' || c_mktsegment AS span, c_custkey, c_name FROM customer),
o AS (SELECT o_custkey, bool_or(o_orderdate >= TIMESTAMP '1998-01-01') AS hit FROM orders GROUP BY o_custkey)
SELECT span, coalesce(string_agg(DISTINCT c_name, ',' ORDER BY c_name) FILTER (WHERE hit), '') AS tests FROM c JOIN o ON c_custkey = o_custkey GROUP BY span""")
def covering_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select(F.concat_ws("/", "c_nationkey", "c_mktsegment").alias("span"), F.col("c_custkey").alias("package"), F.col("c_name").alias("test"))
    hits = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("package")).agg(F.bool_or(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).alias("covered"))
    return coverage.covering_tests(people.join(hits, "package"))


@query("SELECT r_name AS span, string_agg(DISTINCT s_name, ',' ORDER BY s_name) AS names FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY r_name")
def always_run_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("span"), F.col("n_nationkey").alias("package"))
    return coverage.always_run(targets, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("package"), F.col("s_name").alias("name")))


@query("""WITH e AS (SELECT 'p' || l_partkey AS p, 's' || l_suppkey AS t FROM lineitem UNION SELECT 's' || l_suppkey, 's' || l_suppkey FROM lineitem)
SELECT p AS package, string_agg(t, ',' ORDER BY t) AS targets FROM e GROUP BY p""")
def test_scope_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("dep"), F.concat(F.lit("s"), "l_suppkey").alias("target"))
    return scopes.invert(edges, "dep", "target")


@query("""SELECT c_custkey, c_nationkey AS file, n_regionkey AS package, coalesce(CASE WHEN r_regionkey < 3 THEN r_name END, './...') AS scope
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 4 <> 0 LEFT JOIN region ON n_regionkey = r_regionkey""")
def scope_lookup_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("file"))
    owners = table(spark, sf_dir, "nation").where("n_nationkey % 4 <> 0").select(F.col("n_nationkey").alias("file"), F.col("n_regionkey").alias("package"))
    ways = table(spark, sf_dir, "region").where("r_regionkey < 3").select(F.col("r_regionkey").alias("package"), F.col("r_name").alias("scope"))
    return scopes.lookup(rows, owners, ways, default=F.lit("./...")).select("c_custkey", "file", "package", "scope")


@query("""WITH t AS (SELECT p_size AS size, list(DISTINCT p_brand || '.' || p_type ORDER BY p_brand || '.' || p_type) AS tests FROM part GROUP BY p_size),
a AS (SELECT s_nationkey AS size, list(DISTINCT s_name ORDER BY s_name) AS names FROM supplier GROUP BY s_nationkey)
SELECT t.size, '^(' || array_to_string(list_transform(list_concat(tests, coalesce(names, [])), lambda x: regexp_replace(x, '([.#+*?()|])', '\\\\\\1', 'g')), '|') || ')$' AS run
FROM t LEFT JOIN a ON t.size = a.size""".replace("[.#+*?()|]", "[.+*?()|]"))
def run_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("size")).agg(F.sort_array(F.collect_set(F.concat_ws(".", "p_brand", "p_type"))).alias("tests"))
    names = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("size")).agg(F.sort_array(F.collect_set("s_name")).alias("names"))
    return tests.join(names, "size", "left").select("size", scopes.run_expression(F.col("tests"), F.col("names")).alias("run"))


@query("""WITH s AS (SELECT event_id, user_id AS file, CAST(floor(value) AS BIGINT) AS start_line, CAST(floor(value) AS BIGINT) + event_id % 3 AS end_line FROM events),
c AS (SELECT DISTINCT user_id AS file, CASE WHEN user_id % 10 = 0 THEN 0 ELSE CAST(floor(value) AS BIGINT) END AS line FROM events WHERE event_type = 'error' AND event_id % 4 = 0)
SELECT * FROM s WHERE EXISTS (SELECT 1 FROM c WHERE c.file = s.file AND (c.line = 0 OR c.line BETWEEN s.start_line AND s.end_line))""")
def changed_line_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.floor("value").cast("long")
    events = table(spark, sf_dir, "events")
    spans = events.select("event_id", F.col("user_id").alias("file"), at.alias("start_line"), (at + F.col("event_id") % 3).alias("end_line"))
    hits = events.where("event_type = 'error' and event_id % 4 = 0").select(F.col("user_id").alias("file"), at.alias("line"))
    return select.on_changed_lines(spans, select.changed_lines(hits.where("file % 10 <> 0"), hits.where("file % 10 = 0")))


@query("SELECT o_orderkey, o_orderpriority, o_orderdate, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 20")
def top_k_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    return select.top_k_with_total(rows, ["o_orderpriority", "o_orderdate", "o_orderkey"], 20)


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.duplicate_ids(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT p_partkey, 'M-' || left(sha256(concat_ws(chr(0), p_name, p_partkey, p_brand, p_type, p_size, 'x')), 12) AS id FROM part")
def mutation_id_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "part").select("p_partkey", identity.mutation_id(c("p_name"), c("p_partkey"), c("p_brand"), c("p_type"), c("p_size"), F.lit("x")).alias("id"))


@query("SELECT c_custkey, sha256(c_name || chr(0) || c_nationkey || chr(0) || c_mktsegment || chr(0)) AS key, sha256(array_to_string(list_sort([c_name, c_mktsegment]), chr(0))) AS environment FROM customer")
def cache_key_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "customer").select(
        "c_custkey", identity.cache_key(c("c_name"), c("c_nationkey"), c("c_mktsegment")).alias("key"), identity.digest_environment(F.array("c_name", "c_mktsegment")).alias("environment")
    )


_CACHE = "SELECT sha256(CAST(o_custkey AS VARCHAR)) AS key, max(CASE o_orderstatus WHEN 'O' THEN 'KILLED' WHEN 'F' THEN 'SURVIVED' ELSE 'TIMEOUT' END) AS verdict FROM orders GROUP BY o_custkey"


@query(f"""WITH w AS (SELECT c_custkey, sha256(CAST(c_custkey AS VARCHAR)) AS key FROM customer), k AS ({_CACHE}), g AS (SELECT * FROM k WHERE verdict IN ('KILLED', 'SURVIVED', 'INVALID'))
SELECT c_custkey, w.key, g.verdict AS cached_verdict, g.key IS NOT NULL AS hit FROM w LEFT JOIN g ON w.key = g.key""")
def cache_hit_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = table(spark, sf_dir, "customer").select("c_custkey", F.sha2(F.col("c_custkey").cast("string"), 256).alias("key"))
    verdict = F.when(F.col("o_orderstatus") == "O", "KILLED").when(F.col("o_orderstatus") == "F", "SURVIVED").otherwise("TIMEOUT")
    cache = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(verdict).alias("verdict")).select(F.sha2(F.col("o_custkey").cast("string"), 256).alias("key"), "verdict")
    return identity.reuse(work, cache).select("c_custkey", "key", "cached_verdict", "hit")


@query("""WITH r AS (SELECT sha256(CAST(c_custkey AS VARCHAR)) AS key, CASE c_custkey % 3 WHEN 0 THEN 'KILLED' WHEN 1 THEN 'SURVIVED' ELSE 'UNKNOWN' END AS verdict FROM customer)
SELECT key, verdict FROM r WHERE verdict IN ('KILLED', 'SURVIVED', 'INVALID') AND key NOT IN (SELECT sha256(CAST(o_custkey AS VARCHAR)) FROM orders WHERE o_custkey % 4 = 0)""")
def cache_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(F.col("c_custkey") % 3 == 0, "KILLED").when(F.col("c_custkey") % 3 == 1, "SURVIVED").otherwise("UNKNOWN")
    done = table(spark, sf_dir, "customer").select(F.sha2(F.col("c_custkey").cast("string"), 256).alias("key"), verdict.alias("verdict"))
    cache = table(spark, sf_dir, "orders").where("o_custkey % 4 = 0").select(F.sha2(F.col("o_custkey").cast("string"), 256).alias("key")).distinct()
    return identity.to_store(done, cache)


@query("SELECT user_id, event_type, arg_max(props, ts::VARCHAR || lpad(event_id::VARCHAR, 20, '0')) AS props FROM events GROUP BY user_id, event_type")
def env_last_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.canonical_environment(table(spark, sf_dir, "events"), ["user_id"], "event_type", "props", ["ts", "event_id"])


@query("SELECT DISTINCT split_part(regexp_extract(url, '://([^?#]*)', 1), '/', 1) AS dir, regexp_extract(url, '://([^?#]*)', 1) AS file FROM pages".replace("SELECT DISTINCT split_part(regexp_extract(url, '://([^?#]*)', 1), '/', 1) AS dir, regexp_extract(url, '://([^?#]*)', 1) AS file", "SELECT regexp_extract(url, '://([^?#]*)', 1) AS file, max(CAST(page_id AS VARCHAR)) AS package") + " GROUP BY 1")
def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("ImportPath"), F.lit("").alias("Dir"), F.array(F.regexp_extract("url", "://([^?#]*)", 1)).alias("GoFiles"), F.array().cast("array<string>").alias("CgoFiles"))
    return select.source_files(pages)
