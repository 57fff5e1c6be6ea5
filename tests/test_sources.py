import json
import random

import pytest

from verdictlake.functions import diffs, discover
from verdictlake.functions.text import NOT_SCORED
from verdictlake.sinks import findings, history, report
from verdictlake.sources import config, coverage_profile, lines, reports
from verdictlake.sources.diffs import parse_diffs
from verdictlake.streaming import summary

VERSION = "example.report/1"


def valid():
    span = {"file": "a.go", "start_byte": 1, "end_byte": 2, "start_line": 1, "start_column": 2, "end_line": 1, "end_column": 3}
    mutation = {"id": "M-1", "operator": "boundary", "rule_id": "B", "span": span, "original": "<", "replacement": "<=", "description": "d", "suggestion": "s", "diff": "--- a\n+++ b\n"}
    result = {"mutation": mutation, "verdict": "SURVIVED", "duration_ms": 1, "diagnostic": {"id": "D", "location": span, "statement": "x", "evidence": {"k": 1}}}
    counts = dict.fromkeys(("generated", "killed", "survived", "invalid", "timeout", "unknown", "unsupported", "equivalent"), 0) | {"generated": 1, "survived": 1}
    return {
        "schema_version": VERSION, "tool_version": "1", "go_version": "1", "generated_at": "2024-01-01T00:00:00Z", "complete": True, "patterns": ["./..."], "effective_config": {"timeout": "1s"},
        "bounds": {"discovered_before_bound": 1, "retained_after_bound": 1, "completed_mutants": 1, "max_mutants": 0}, "semantics": ["s"], "summary": counts | {"score": 0.0, "score_text": f"0.0% {NOT_SCORED}"},
        "results": [result], "timing": {"parsing_ms": 1, "baseline_ms": 2, "execution_ms": 3, "rendering_ms": 0, "total_ms": 6},
    }


def put(path, value):
    def change(r):
        *way, last = path
        for k in way:
            r = r[k]
        r[last] = value

    return change


def drop(*path):
    def change(r):
        *way, last = path
        for k in way:
            r = r[k]
        del r[last]

    return change


BAD = {
    "version": put(["schema_version"], "other/1"), "no version": drop("schema_version"), "no summary field": drop("summary", "killed"), "no span field": drop("results", 0, "mutation", "span", "end_line"),
    "no diagnostic": drop("results", 0, "diagnostic"), "verdict": put(["results", 0, "verdict"], "FINE"), "negative count": put(["summary", "killed"], -1), "fraction": put(["summary", "killed"], 0.5),
    "score": put(["summary", "score"], 50.0), "score text": put(["summary", "score_text"], "0%"), "bounds": put(["bounds", "completed_mutants"], 0), "fractional bound": put(["bounds", "retained_after_bound"], 1.5),
    "patterns": put(["patterns"], []), "config": put(["effective_config"], {}), "semantics": put(["semantics"], []), "zero time": put(["generated_at"], "0001-01-01T00:00:00Z"), "no time": put(["generated_at"], "x"),
    "span": put(["results", 0, "mutation", "span", "end_byte"], 1), "timing": put(["timing", "total_ms"], -1), "empty id": put(["results", 0, "mutation", "id"], ""), "null results": put(["results"], None),
    "false complete": put(["bounds"], {"discovered_before_bound": 3, "retained_after_bound": 2, "completed_mutants": 1}),
}


@pytest.mark.parametrize("name", BAD)
def test_corrupt_reports(name):
    r = valid()
    BAD[name](r)
    with pytest.raises(reports.BadReport):
        reports.decode_report(json.dumps(r), VERSION)


@pytest.mark.parametrize("text", ["null", "[]", "", "{}", json.dumps(valid()) + "{}", json.dumps(valid()) + " x", json.dumps(valid()).replace('"completed_mutants": 1', '"completed_mutants": 1e0')])
def test_corrupt_documents(text):
    with pytest.raises(reports.BadReport):
        reports.decode_report(text, VERSION)


def test_duplicate_ids_are_refused():
    r = valid()
    r["results"] *= 2
    r["bounds"] = dict.fromkeys(r["bounds"], 2)
    r["summary"] |= {"generated": 2, "survived": 2}
    with pytest.raises(reports.BadReport, match="repeated"):
        reports.decode_report(json.dumps(r), VERSION)


def test_reports_to_rows_and_back(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(valid(), indent=1))
    found = reports.read_reports(spark, str(tmp_path), VERSION)
    flat = reports.results_of(found)
    assert [r["id"] for r in flat.collect()] == ["M-1"]
    out = []
    header = reports.decode_report(json.dumps(valid()), VERSION)
    for form in report.FORMATS:
        report.render(flat.drop("path"), header, form, out.append, tool="tool")
    assert "SURVIVED M-1 a.go:1:2 d" in "".join(out) and "::warning file=a.go,line=1" in "".join(out)
    (tmp_path / "b.json").write_text("{}")
    with pytest.raises(reports.BadReport):
        reports.read_reports(spark, str(tmp_path), VERSION)


def test_history(spark, tmp_path):
    path = str(tmp_path / "h.ndjson")
    assert lines.read_history(spark, path).count() == 0
    for label, score in (("PR #101", 71.2), ("PR #1", 74.8)):
        entry = history.entry_of(valid() | {"summary": valid()["summary"] | {"score": score}}, label, "2024-01-01T00:00:00Z")
        history.append_entry(path, entry)
    assert history.trend_text(lines.read_history(spark, path)) == "PR #101  71.2%\nPR #1    74.8%\n"
    with open(path, "a") as f:
        f.write("\n{bad\n")
    with pytest.raises(lines.BadLine, match="line 4"):
        lines.read_history(spark, path)


def test_events(spark):
    text = '{"Action":"run","Package":"p","Test":"T"}\n\nnot json\n' + '{"Action":"output","Output":"' + "x" * (256 << 10) + '"}\n{"Action":"pass"}'
    df = spark.createDataFrame([("s", text)], "stream_id string, text string")
    got = [(r["Action"], r["lost"]) for r in lines.parse_events(df).orderBy("seq").collect()]
    assert got == [("run", False), ("", True), ("", True), ("", True)]


def test_packages(spark):
    df = spark.createDataFrame([("a", '{"ImportPath":"x","Deps":["y"]}\n{"ImportPath":"y","ForTest":"x"} ')], "path string, text string")
    assert sorted(r["ImportPath"] for r in lines.parse_packages(df).collect()) == ["x", "y"]


BAD_ROWS = ["", "mode: x\n", "a.go:1.1,2.2 1 1\n", "mode: set\na.go:1.1,2.2 1\n", "mode: set\n\n", "mode: set\na.go:0.1,2.2 1 1\n", "mode: set\na.go:3.1,2.2 1 1\n", "mode: set\na.go:1.1,2.2 1 2\n", "mode: count\na.go1.1,2.2 1 1\n", "mode: count\na.go:1.1,9000000.2 1 1\n", "mode: count\na.go:1.1,2.2 -1 1\n", "mode: count\na.go:1.1,2.2 1 1\nbad\n"]


def test_coverage_profiles(spark, tmp_path):
    good = spark.createDataFrame([("g", "mode: count\n/r/m/p.go:7.1,9.2 1 1\nq.go:1.1,1.2 1 0\n"), ("h", "mode: set\n")], "profile_id string, text string")
    rows = coverage_profile.parse_profiles(good, "/r").collect()
    assert all(r["ok"] for r in rows) and {r["file"] for r in rows} == {"m/p.go", "q.go", None}
    bad = spark.createDataFrame(list(enumerate(BAD_ROWS)), "profile_id long, text string")
    refused = {r["profile_id"] for r in coverage_profile.parse_profiles(bad).where("not ok").collect()}
    assert refused == set(range(len(BAD_ROWS)))
    (tmp_path / "x").write_text(BAD_ROWS[2])
    with pytest.raises(coverage_profile.BadProfile):
        coverage_profile.read_profiles(spark, str(tmp_path))


HEAD = "diff --git a/x.go b/x.go\n--- a/x.go\n+++ b/x.go\n"


@pytest.mark.parametrize("text, want", [
    ("", []), (HEAD + "@@ -2,0 +3,2 @@\n+a\n+b\n", [("x.go", 3), ("x.go", 4)]), (HEAD + "@@ -1 +0,0 @@\n-a\n", []), ("diff --git a/x b/x\nBinary files a/x and b/x differ\n", []),
    (HEAD + "@@ -0,0 +1 @@\n+++ b/other.go\n", [("x.go", 1)]), ('diff --git "a/\\303\\251" "b/\\303\\251"\n--- "a/\\303\\251"\n+++ "b/\\303\\251"\n@@ -1 +1 @@\n-a\n+b\n\\ No newline at end of file\n', [("é", 1)]),
    ("diff --git a/x b/x\n--- a/x\n+++ /dev/null\n@@ -1 +0,0 @@\n-a\n", []),
])
def test_changed_lines(text, want):
    assert list(diffs.changed_lines(text)) == want


@pytest.mark.parametrize("text", ["x", HEAD + "@@ -1 +1 @@\n-a\n", HEAD + "@@ bad\n", "diff --git a/x b/x\n--- a/x\n", "diff --git a/x b/x\n", HEAD + "@@ -1 +1 @@\n-a\n+b\n+c\n", "diff --git a/x b/x\n--- x\n+++ b/x\n", HEAD + "--- a/x.go\n"])
def test_malformed_diffs(spark, text):
    with pytest.raises(diffs.BadDiff):
        list(diffs.changed_lines(text))


def test_diff_table(spark):
    df = spark.createDataFrame([(1, HEAD + "@@ -1 +1 @@\n-a\n+b\n"), (2, "bad"), (3, None)], "id long, diff string")
    rows = parse_diffs(df).collect()
    assert [(r["id"], r["line"]) for r in rows] == [(1, 1), (2, None)] and rows[1]["error"]


def test_diffs_round_trip():
    rng = random.Random(729331)
    for _ in range(400):
        source = "".join(rng.choice(["a", "bé", "\n", "\r\n", "x\ty"]) for _ in range(rng.randint(0, 12))).encode()
        i = rng.randint(0, len(source))
        j = rng.randint(i, len(source))
        new = rng.choice([b"", b"z", b"p\nq", b"\n"])
        d = diffs.unified_diff("d/é.go", source, i, j, new)
        assert diffs.apply_unified(source, d) == diffs.splice(source, i, j, source[i:j], new), (source, i, j, new, d)


def test_discovery(spark):
    source = b'package p\n\nimport "x"\n\nfunc f(a int, p *int) bool {\n\tfor i := 0; i < 3; i++ {\n\t\ta -= 1\n\t}\n\treturn a == 1 && !ok("s")\n}\n'
    got = {(r["rule_id"], r["original"]) for r in discover.mutation_rows("p.go", source, discover.FAMILIES)}
    assert {("BOUNDARY", "<"), ("LOOP-COND-FALSE", "i < 3"), ("ASSIGN-OP", "-="), ("RELATIONAL", "=="), ("CONN-SWAP", "&&"), ("BOOL-DROP-NOT", '!ok("s")'), ("LITERAL-STRING-EMPTY", '"s"')} <= got
    assert ("ASSIGN-INCDEC", "++") not in got and ("ARITHMETIC", "*") not in got and ("LITERAL-STRING-EMPTY", '"x"') not in got and ("LITERAL-INC", "3") not in got
    assert [r["rule_id"] for r in discover.mutation_rows("p.go", source, discover.FAMILIES, {9})][0] and discover.mutation_rows("p.go", b"`open", discover.FAMILIES) == []
    df = spark.createDataFrame([("p.go", source.decode())], "file string, source string")
    found = discover.with_diffs(discover.discover(df, families=("boundary",)).limit(1), df).collect()
    assert found[0]["diff"].startswith("--- a/p.go\n+++ b/p.go\n@@ -6 +6 @@\n")
    changed = spark.createDataFrame([("p.go", 7)], "file string, line long")
    assert {r["rule_id"] for r in discover.discover(df, families=discover.FAMILIES, changed=changed).collect()} == {"ASSIGN-OP", "LITERAL-INC", "LITERAL-DEC"}


def test_settings(tmp_path):
    s = config.parse_settings('timeout = "2m" # x\noperators = ["boundary", literal]\nworkers=3\ncoverage_test_selection = true\n')
    assert s["timeout"] == "2m" and s["operators"] == ["boundary", "literal"] and s["workers"] == 3 and s["coverage_test_selection"] is True
    assert config.parse_settings("operators:\n  - boundary\n  - 'loop'\nformat: json\n", yaml=True)["operators"] == ["boundary", "loop"]
    for bad in ("[x]\n", "a = 1\n", "timeout = 0s\n", "operators = nope\n", "format = x\n", "workers = -1\n", "timeout\n", "timeout = \n", 'format = "json\n'):
        with pytest.raises(config.BadSettings):
            config.parse_settings(bad)
    (tmp_path / "go.mod").write_text("")
    (tmp_path / "d").mkdir()
    (tmp_path / "s.toml").write_text("workers = 2\n")
    assert config.find_settings(str(tmp_path / "d"), ("s.toml",))["workers"] == 2


def test_sarif(spark):
    df = spark.createDataFrame([(2, "R", "late", "SURVIVED", "a.go", 1), (1, "R", "first", "TIMEOUT", "a,b.go", None), (3, "S", "x", "KILLED", "a.go", 1)], "seq long, rule_id string, description string, verdict string, file string, start_line long")
    doc = json.loads(findings.sarif(df, tool="t", version="1"))["runs"][0]
    assert [r["id"] for r in doc["tool"]["driver"]["rules"]] == ["R"] and doc["tool"]["driver"]["rules"][0]["shortDescription"]["text"] == "first"
    assert [r["level"] for r in doc["results"]] == ["note", "warning"]
    assert findings.annotations(df).orderBy("seq").first()["command"].startswith("::notice file=a%2Cb.go,line=1,")


def test_live_classification_agrees_with_batch(spark, tmp_path):
    rows = [("a", 1, "p", "T", "run", False, False), ("a", 2, "p", "T", "pass", False, False), ("a", 3, "", "", "end", False, False), ("b", 1, "p", "", "output", True, False), ("b", 2, "", "", "end", False, False), ("c", 1, "p", "T", "run", False, False), ("c", 2, "", "", "end", False, False), ("d", 1, "p", "T", "run", False, False)]
    schema = "stream_id string, seq long, Package string, Test string, Action string, broken boolean, lost boolean"
    for i, part in enumerate((rows[:1] + rows[3:4], rows[1:3] + rows[4:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = summary.classify_live(stream).writeStream.format("memory").queryName("live").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["stream_id"]: (r["verdict"], r["tests"]) for r in spark.table("live").collect()} == {"a": ("KILLED", ""), "b": ("INVALID", ""), "c": ("KILLED", "T")}
