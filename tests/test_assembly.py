"""Guards of discovery, discarded results, spools and gates."""

import json

import pytest
from pyspark.sql import functions as F

from verdictlake.functions.discover import FAMILIES, mutation_rows
from verdictlake.operators import assemble, discards, select, spool
from verdictlake.sinks import history, report
from verdictlake.sources import config


def rules(body: str, *families: str) -> list[tuple[str, str, str]]:
    return sorted((r["rule_id"], r["original"], r["replacement"]) for r in mutation_rows("f.go", f"package p\n{body}".encode(), families or FAMILIES))


@pytest.mark.parametrize(
    "body",
    [
        "func f(true int) int { return true }", "const true = 1\nvar x = true", "func f() { true, x := g(); use(true, x) }",
    ],
)
def test_own_truths_are_left_alone(body):
    assert rules(body, "boolean") == []


@pytest.mark.parametrize(
    "body",
    [
        "mu.Lock()", "log.Print(1)", "wg.Add(1)", "close(c)", "x := g()", "x = 1", "go func() { t.n = 1 }()", "for !done() { t.step() }", "for i := 0; i < n; i++ { t.put(i) }", "y := 1\n\tt.n = y",
    ],
)
def test_statements_that_stay(body):
    assert rules(f"func f() {{\n\t{body}\n}}\n", "statement") == []


def test_statements_that_may_go():
    assert rules("func f() {\n\tt.n = 1; h()\n\tt.x[2] += 3\n\t*p--\n\tfor _, x := range xs { t.put(n) }\n}\n", "statement") == [
        ("STMT-DELETE-ASSIGN", "*p--", ""), ("STMT-DELETE-ASSIGN", "t.n = 1", ""), ("STMT-DELETE-ASSIGN", "t.x[2] += 3", ""), ("STMT-DELETE-CALL", "h()", ""), ("STMT-DELETE-CALL", "t.put(n)", "")
    ]


def test_imports_stay_used():
    one = 'import "a/fmt"\nfunc f() {\n\tfmt.Do(1)\n}\n'
    assert rules(one, "statement") == [] and rules(one + "func g() { fmt.Do(2) }\n", "statement") != []


@pytest.mark.parametrize(
    "body",
    [
        "if true { h() }", "for { if a { break } }", "for i := 0; i < n; i++ { if i > 2 { h() } }", "for _, x := range c { if x { break } }", "if a { mu.Unlock() }", "if a { <-c }", "l:\n\tif a { goto l }", "if a { f() }",
    ],
)
def test_conditions_that_stay(body):
    assert rules(f"func f() {{\n\t{body}\n}}\n", "condition") == []


def test_conditions_of_other_families_are_theirs():
    body = "func f() {\n\tif !a { h() }\n\tif a == b { h() } else if c { h() }\n}\n"
    assert rules(body, "condition") == [("COND-NEGATE", "!a", "!(!a)"), ("COND-NEGATE", "a == b", "!(a == b)"), ("COND-NEGATE", "c", "!(c)")]
    assert [r for r in rules(body, "condition", "boolean", "relational") if r[0] == "COND-NEGATE"] == [("COND-NEGATE", "c", "!(c)")]


def test_returned_values():
    body = "func f(a int) (n int, s string, m map[string]int, e error) {\n\treturn a + 1, h(a), make(map[string]int), err\n}\nfunc (t *T) g() []int { return t.xs }\nvar k = func() string { return t.name }\n"
    assert rules(body, "returnvalue") == [("RET-ZERO", "a + 1", "0"), ("RET-ZERO", "h(a)", '""'), ("RET-ZERO", "t.name", '""'), ("RET-ZERO", "t.xs", "nil")]


def test_errors_and_slices():
    body = "const lim = 2\nfunc f() error {\n\tif (err) != nil {\n\t\th()\n\t\treturn err\n\t}\n\ts = s[a|b : lim]\n\tfor len(s) < n { s = s[:m] }\n\treturn nil\n}\n"
    assert rules(body, "errorreturn", "bounds") == [("ERR-SWALLOW", "err", "nil"), ("SLICE-LOW", "a|b", "(a|b) + 1")]


def test_equivalents():
    body = "func f() bool {\n\tv := true\n\tif c {\n\t\tv = g()\n\t} else {\n\t\tv = h()\n\t}\n\tw := true\n\tw = w && c\n\tif a.x != b[1] {\n\t\treturn b[1] < a.x\n\t}\n\tif g() != b {\n\t\treturn g() < b\n\t}\n\treturn v\n}\n"
    found = {(r["start_line"], r["rule_id"]): r["equivalent_reason"] is not None for r in mutation_rows("f.go", f"package p\n{body}".encode(), ("boundary", "boolean"))}
    assert found[3, "BOOL-LITERAL"] and not found[9, "BOOL-LITERAL"] and found[12, "BOUNDARY"] and not found[15, "BOUNDARY"]


def test_mentions():
    found = discards.mentions_of(b"package p\nfunc f() int { return 1 }\nfunc g() {\n\tf()\n\t_ = f()\n\tdefer f()\n\tx := f()\n\th(f)\n\tif f() > 1 { f() }\n\tt.f()\n}\n")
    assert sorted(d for n, d in found if n == "f") == [False, False, False, True, True, True, True]
    assert discards.linknames_of(b"//go:linkname f a/b.g\n// go:linkname x y\n") == ["f", "g"]


def test_spool(spark, tmp_path):
    rows = spark.range(1000).select((F.lit(999) - F.col("id")).alias("ordinal"))
    path = f"file://{tmp_path}/spool"
    assert spool.write_spool(rows, path) == 1000
    assert [r[0] for r in spool.read_spool(spark, path, 1000).limit(3).collect()] == [0, 1, 2]
    for expected in (999, 1001):
        with pytest.raises(spool.BadSpool):
            spool.read_spool(spark, path, expected)


def test_interrupted_runs(spark):
    planned = spark.createDataFrame([(r, i) for r in "ab" for i in range(4)] + [("c", 0)], "run string, ordinal long")
    results = planned.where("not (run = 'a' and ordinal = 2) and run <> 'c'")
    got = {r["run"]: (r["committed"], r["complete"]) for r in assemble.contiguous(results, planned).collect()}
    assert got == {"a": (2, False), "b": (4, True), "c": (0, False)}
    assert assemble.commit(results, assemble.contiguous(results, planned)).groupBy("run").count().orderBy("run").collect() == [("a", 2), ("b", 4)]


def test_changed_lines_of_long_and_odd_spans(spark):
    spans = spark.createDataFrame([(1, "a", 1, 3), (2, "a", 5, 500), (3, "a", 600, 700), (4, "b", 1, 1), (5, "c", 9, 9), (5, "c", 9, 9), (6, "a", 8, 7)], "id long, file string, start_line long, end_line long")
    changed = spark.createDataFrame([("a", 3), ("a", 400), ("b", 0), ("c", 9), ("c", 9)], "file string, line long")
    assert sorted(r["id"] for r in select.on_changed_lines(spans, changed).collect()) == [1, 2, 4, 5, 5]


def test_gate(spark):
    compared = spark.createDataFrame([("new_survivors",), ("unchanged",)], "bucket string")
    assert assemble.new_survivor_gate(compared) == 10 and assemble.new_survivor_gate(compared.where("bucket = 'unchanged'")) == 0


def _results(spark):
    rows = [(0, "M-1", "KILLED", "a.go"), (1, "M-2", "SURVIVED", "b<.go"), (2, "M-3", "EQUIVALENT", "c.go"), (3, "M-4", "SURVIVED", "a.go")]
    df = spark.createDataFrame(rows, "ordinal long, id string, verdict string, file string")
    extra = {"start_line": F.lit(3), "start_column": F.lit(1), "rule_id": F.lit("R"), "description": F.lit("swap"), "suggestion": F.lit("try"), "diff": F.lit("-a\n+b\n"), "equivalent_reason": F.lit("proof")}
    extra |= {"coverage_known": F.lit(True), "covered_by_selected_tests": F.lit(True), "cached": F.lit(False), "responsible_tests": F.array(F.lit("T")), "responsible_assertions": F.lit(None).cast("array<struct<test:string>>"), "responsible_panics": F.lit(None).cast("array<struct<test:string>>")}
    return df.withColumns(extra)


HEADER = {"tool_version": "1", "complete": False, "patterns": ["./..."], "bounds": {"max_mutants": 4}, "warnings": ["w&"], "semantics": ["s"], "summary": {k: 1 for k in (*report.findings.MESSAGES, "generated", "killed", "survived", "invalid", "timeout", "unknown", "unsupported", "equivalent")} | {"score_text": "50.0%"}, "timing": {"parsing_ms": 1, "baseline_ms": 1, "execution_ms": 1, "rendering_ms": 0, "total_ms": 3}}


def test_pages(spark):
    out: list[str] = []
    header = report.measured(lambda h, w: report.render(_results(spark), h, "html", w, tool="t"), HEADER, out.append, iter([1.0, 1.5]).__next__)
    page = "".join(out)
    assert header["timing"]["rendering_ms"] == 500 and "500 ms" in page and "Incomplete" in page and "w&amp;" in page
    at = [page.index(x) for x in ("Survivors", "M-2", "M-4", "Noticed by a test", "M-1", "Proved to change nothing", "proof")]
    assert at == sorted(at) and "b&lt;.go" in page and page.count("suggested test") == 2


def test_documents_in_pieces(spark):
    rows = _results(spark).withColumnRenamed("ordinal", "seq")
    doc = json.loads(report.findings.sarif(rows, tool="t", version="1"))
    assert [r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] for r in doc["runs"][0]["results"]] == ["b<.go", "a.go"]
    compared = spark.createDataFrame([("new_survivors", "a", "x.go", 3, 1), ("unchanged", "b", "x.go", 1, 1)], "bucket string, id string, file string, start_line long, start_column long").withColumns({"baseline_verdict": F.lit(None).cast("string"), "current_verdict": F.lit("SURVIVED")})
    got = json.loads(report.comparison_json(compared, {"comparable": True}))
    assert got["unchanged"] == 1 and [r["id"] for r in got["new_survivors"]] == ["a"] and got["still_open"] == []
    assert "new survivors: 1" in "".join(report.comparison_html(compared, header={"team": "<t>"}))


def test_writers_stop_at_a_failure(tmp_path):
    def fail(text):
        raise OSError("full")

    w = report.Sticky(fail)
    w("a"), w("b")
    assert str(w.error) == "full" and w.characters == 0 and report.progress_line(1, 2, {"verdict": "KILLED", "id": "M", "file": "f", "start_line": 3}) == "[1/2] KILLED M f:3"
    path = f"{tmp_path}/deep/journal"
    history.append_journal(path, time="t", reason="interrupted", patterns=["p"], completed=1, retained=2)
    assert json.loads(open(path).read())["complete"] is False
    assert json.loads(config.effective_settings({**config.DEFAULTS, "workers": 3}))["workers"] == 3
