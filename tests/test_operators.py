from pyspark.sql import functions as F

from verdictlake.functions import text as X
from verdictlake.operators import compare, coverage, events, identity, scopes, select, verdicts


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def test_buckets(spark):
    base = [("still-killed", "KILLED"), ("still-survived", "SURVIVED"), ("regressed", "KILLED"), ("fixed", "SURVIVED"), ("removed-survivor", "SURVIVED"), ("removed-killed", "KILLED"), ("confirmed", "TIMEOUT"), ("inconclusive", "SURVIVED"), ("reclassified", "SURVIVED")]
    cur = [("still-killed", "KILLED"), ("still-survived", "SURVIVED"), ("regressed", "SURVIVED"), ("fixed", "KILLED"), ("confirmed", "SURVIVED"), ("inconclusive", "TIMEOUT"), ("reclassified", "INVALID"), ("brand-new", "SURVIVED")]
    out = compare.compare_runs(spark.createDataFrame(base, "id string, verdict string"), spark.createDataFrame(cur, "id string, verdict string"))
    got = dict(rows(out, "id", "bucket"))
    assert got == {
        "still-killed": "unchanged", "still-survived": "unchanged", "regressed": "new_survivors", "fixed": "fixed_survivors", "removed-survivor": "removed_mutants", "removed-killed": "removed_mutants",
        "confirmed": "new_survivors", "inconclusive": "still_open", "reclassified": "reclassified", "brand-new": "new_survivors",
    }
    assert sum(r["n"] for r in compare.bucket_counts(out).collect()) == len(got)
    assert dict(rows(compare.explore(out), "id", "exploratory"))["removed-killed"] == "not_analyzed"


def test_last_of_repeated_ids_counts(spark):
    base = spark.createDataFrame([("a", "KILLED", 1), ("a", "SURVIVED", 2)], "id string, verdict string, n long")
    cur = spark.createDataFrame([("a", "KILLED", 1)], "id string, verdict string, n long")
    assert rows(compare.compare_runs(base, cur, order="n"), "id", "bucket") == [("a", "fixed_survivors")]


def test_shifts_need_unique_fingerprints(spark):
    schema = "id string, file string, start_line long, verdict string"
    gone = spark.createDataFrame([("old", "a.go", 5, "SURVIVED"), ("x1", "b.go", 1, "SURVIVED"), ("x2", "b.go", 2, "SURVIVED")], schema)
    new = spark.createDataFrame([("new", "a.go", 12, "SURVIVED"), ("y", "b.go", 3, "SURVIVED")], schema)
    assert rows(compare.shift_candidates(gone, new, fingerprint=("file",)), "removed_id", "new_id", "old_line", "new_line", "verdict_changed") == [("old", "new", 5, 12, False)]


def test_incompatible_headers(spark):
    a = spark.createDataFrame([("p", 1, None)], "patterns string, n long, x string")
    b = spark.createDataFrame([("p", 2, None)], "patterns string, n long, x string")
    assert rows(compare.incompatibilities(a, b, ("patterns", "n", "x")), "field") == [("n",)]


def test_coverage_is_three_valued(spark):
    spans = spark.createDataFrame([("hit", "a.go", 3, 4), ("miss", "a.go", 9, 9), ("zero", "z.go", 1, 1), ("none", "u.go", 1, 1)], "id string, file string, start_line long, end_line long")
    blocks = spark.createDataFrame([("a.go", 4, 6, 1), ("z.go", 1, 5, 0)], "file string, start_line long, end_line long, count long")
    want = {"hit": True, "miss": False, "zero": False, "none": None}
    for grid in (False, True):
        assert dict(rows(coverage.annotate(spans, blocks, grid=grid), "id", "covered")) == want


def test_suffixes_of_two_files_are_ambiguous(spark):
    files = spark.createDataFrame([("m/a/x.go",), ("m/b/x.go",), ("m/b/y.go",)], "file string")
    index = coverage.suffix_index(files)
    got = dict(rows(index))
    assert "x.go" not in got and got["y.go"] == "m/b/y.go" and got["a/x.go"] == "m/a/x.go"
    spans = spark.createDataFrame([("1", "m/a/x.go"), ("2", "x.go"), ("3", "y.go")], "id string, file string")
    assert rows(coverage.resolve(spans, index), "id", "covered_file") == [("1", "m/a/x.go"), ("2", None), ("3", "m/b/y.go")]


def test_strict_covering_tests(spark):
    possible = spark.createDataFrame([("s", "p"), ("s", "q"), ("t", "p"), ("u", "p"), ("u", "r")], "span string, package string")
    profiles = spark.createDataFrame([("s", "p", "A", True), ("s", "q", "A", True), ("s", "q", "B", False), ("t", "p", "A", None), ("u", "p", "A", True)], "span string, package string, test string, covered boolean")
    assert rows(coverage.covering_tests_strict(possible, profiles)) == [("s", True, "A"), ("t", False, None), ("u", False, None)]


def test_scope_of_a_package(spark):
    packages = spark.createDataFrame([("b", ["a", "fmt"]), ("d", ["a", "d [d.test]"]), ("a", []), ("e", ["c"]), ("", ["a"])], "ForTest string, Deps array<string>")
    got = dict(rows(scopes.test_scope_index(packages)))
    assert got["a"] == "a,b,d" and got["c"] == "e" and "d [d.test]" not in got


def test_run_expression(spark):
    df = spark.createDataFrame([(["T.a", "U"], ["ExampleX"], ""), ([], ["E"], ""), (["T"], None, "^mine$")], "t array<string>, a array<string>, r string")
    assert [r[0] for r in df.select(scopes.run_expression(F.col("t"), F.col("a"), F.col("r"))).collect()] == [r"^(T\.a|U|ExampleX)$", None, "^mine$"]


def test_changed_lines(spark):
    spans = spark.createDataFrame([("a", "f", 2, 3), ("b", "f", 5, 5), ("c", "g", 9, 9), ("d", "h", 1, 1)], "id string, file string, start_line long, end_line long")
    tracked = spark.createDataFrame([("f", 3), ("g", 1)], "file string, line long")
    changed = select.changed_lines(tracked, spark.createDataFrame([("g",)], "file string"))
    assert rows(select.on_changed_lines(spans, changed), "id") == [("a",), ("c",)]
    assert select.on_changed_lines(spans, None) is spans


def test_top_k_counts_all(spark):
    got = select.top_k_with_total(spark.range(50), ["id"], 3).collect()
    assert [(r["id"], r["total"]) for r in got] == [(0, 50), (1, 50), (2, 50)]
    assert select.top_k_with_total(spark.range(50), ["id"], 0).count() == 50


def test_streams(spark):
    e = [
        ("fail", 1, "p", "T", "run", ""), ("fail", 2, "p", "T", "fail", ""), ("rerun", 1, "p", "T", "run", ""), ("rerun", 2, "p", "T", "fail", ""), ("rerun", 3, "p", "T", "run", ""), ("rerun", 4, "p", "T", "pass", ""),
        ("open", 1, "p", "T", "run", ""), ("build", 1, "p", "", "output", "FAIL\tp [build failed]\n"), ("sibling", 1, "q", "T", "run", ""), ("sibling", 2, "q", "T", "pass", ""), ("sibling", 3, "p", "", "output", "FAIL\tp [setup failed]"),
        ("inner", 1, "p", "T", "run", ""), ("inner", 2, "p", "T", "output", "FAIL\tp [build failed]"), ("inner", 3, "p", "T", "pass", ""), ("cr", 1, "p", "", "output", "FAIL\tp [x]\rmore"),
    ]
    df = spark.createDataFrame(e, "stream_id string, seq long, Package string, Test string, Action string, Output string")
    got = {r["stream_id"]: (r["verdict"], r["tests"]) for r in events.classify_streams(df).collect()}
    assert got == {"fail": ("KILLED", "T"), "rerun": ("KILLED", "T"), "open": ("KILLED", "T"), "build": ("INVALID", ""), "sibling": ("INVALID", ""), "inner": ("KILLED", ""), "cr": ("KILLED", "")}
    lost = events.classify_streams(df.withColumn("lost", F.lit(True)), incomplete="lost")
    assert {r["stream_id"]: r["verdict"] for r in lost.collect()}["build"] == "UNKNOWN"


def test_evidence_budget_passes_over_what_does_not_fit(spark):
    df = spark.createDataFrame([("s", 1, 60), ("s", 2, 50), ("s", 3, 40), ("s", 4, 1)], "k string, n long, size long")
    got = events.evidence_budget(df, stream="k", seq="n", size="size", max_events=3, max_bytes=100).first()
    assert (got["kept"], got["used"], got["seqs"]) == (2, 100, [1, 3])


def test_identity(spark):
    row = spark.range(1).select(identity.mutation_id(*map(F.lit, ("a.go", 5, "boundary", "B", "<", "<="))).alias("id"), identity.valid_key(F.lit("0" * 64)).alias("ok"), identity.valid_key(F.lit("A" * 64)).alias("no")).first()
    assert len(row["id"]) == 14 and row["ok"] and not row["no"]


def test_summary_of_odd_verdicts(spark):
    df = spark.createDataFrame([("KILLED",), ("SURVIVED",), (None,), ("??",), ("EQUIVALENT",)] + [("KILLED",)] * 14, "verdict string")
    s = verdicts.summarize(df).first()
    assert (s["generated"], s["killed"], s["survived"], s["unknown"], s["equivalent"]) == (19, 15, 1, 2, 1)
    assert s["score"] == 93.75 and s["score_text"].startswith("93.8%")
    empty = verdicts.summarize(df.limit(0)).first()
    assert empty["generated"] == 0 and empty["score"] == 0.0 and empty["score_text"] == X.NO_SCORE


def test_halves_go_to_even(spark):
    df = spark.createDataFrame([(6.25,), (12.35,), (0.05,)], "x double")
    assert [r[0] for r in df.select(X.one_decimal(F.col("x"))).collect()] == [f"{v:.1f}" for v in (6.25, 12.35, 0.05)]


def test_texts(spark):
    f = lambda c: spark.range(1).select(c).first()[0]
    assert f(X.collapse_spaces(F.lit(" a \n b "))) == "a b"
    assert f(X.clip_message(F.lit("x" * 241))) == "x" * 240 + "…"
    assert f(X.quote_meta(F.lit("a.b[c]"))) == r"a\.b\[c\]"
    assert f(X.old_text(F.lit("--- a/x\n+++ b/x\n@@ -1 +1 @@\n-old\n+new\n-no"))) == "old"
    assert f(X.old_text(F.lit("no diff"))) == ""
    assert f(X.clean_path(F.lit("/r/./a//b.go"), "/r")) == "a/b.go"
    assert f(X.failing_tests(F.lit("--- FAIL: B (0s)\n    --- FAIL: A/x\nok"))) == ["A/x", "B"]
