from verdictlake.operators import evidence, trees
from verdictlake.sinks import report

EVENTS = [
    ("s", 1, "p", "T", "run", ""), ("s", 2, "p", "T", "output", "    a_test.go:7: got 1\n"), ("s", 3, "p", "T", "output", "    a_test.go:7: got 1\n    b_test.go:9: \n"), ("s", 4, "p", "T", "output", "        Trace: x\n        Error:  not equal\n"),
    ("s", 5, "p", "T", "output", "panic: boom\n"), ("s", 6, "p", "T", "output", "goroutine 7 [running]:\n"), ("s", 7, "p", "T", "fail", ""), ("s", 8, "p", "U", "run", ""), ("s", 9, "p", "U", "output", "panic: only printed\n    x_test.go:0: no\n--- a_test.go:1: no\n"),
    ("s", 10, "p", "U", "fail", ""), ("s", 11, "p", "V", "run", ""), ("s", 12, "p", "V", "output", "    v_test.go:1: passed\n"), ("s", 13, "p", "V", "pass", ""),
]


def test_assertions_and_panics(spark):
    df = spark.createDataFrame(EVENTS, "stream_id string, seq long, Package string, Test string, Action string, Output string")
    got = [tuple(a) for a in evidence.assertions(df).first()["assertions"]]
    assert got == [("T", "a_test.go", 7, "got 1"), ("T", "b_test.go", 9, "not equal")]
    assert [tuple(p) for p in evidence.panics(df).first()["panics"]] == [("T", "panic: boom")]
    assert len(evidence.assertions(df, cap=1).first()["assertions"]) == 1


def test_clips_keep_characters_whole():
    assert evidence.clip_bytes("aéb", 2) == "a" and evidence.clip_bytes("aéb", 4) == "aéb"


def test_trees(spark):
    schema = "tree string, rel string, kind string, mode long, content string"
    a = [("a", "x/y", "file", 420, "1"), ("a", "x", "dir", 493, None), ("a", "z", "file", 420, "q")]
    b = [("b", r, k, m, "2" if r == "x/y" else c) for _, r, k, m, c in a[:2]] + [("b", "new", "file", 420, "")]
    df = spark.createDataFrame(a + b + [("c", *x[1:]) for x in reversed(a)], schema)
    d = {r["tree"]: r["digest"] for r in trees.tree_digest(df).collect()}
    assert d["a"] == d["c"] != d["b"]
    diff = trees.tree_differences(df.where("tree = 'a'"), df.where("tree = 'b'"))
    assert sorted(tuple(r) for r in diff.collect()) == [("new", "extra"), ("x/y", "content"), ("z", "missing")]
    assert trees.frame(b"a" * 300)[:2] == b"\xac\x02"


def test_comparison_rendering(spark):
    rows = [("a", "KILLED", "SURVIVED", "new_survivors", "f.go", 3, 1), ("b", "SURVIVED", None, "removed_mutants", "f.go", 1, 1), ("c", "KILLED", "KILLED", "unchanged", "f.go", 9, 1)]
    df = spark.createDataFrame(rows, "id string, baseline_verdict string, current_verdict string, bucket string, file string, start_line long, start_column long")
    shifts = spark.createDataFrame([("b", "a", 1, 3)], "removed_id string, new_id string, old_line long, new_line long")
    assert list(report.comparison_text(df, shifts)) == ["new_survivors:", "  a f.go:3 KILLED -> SURVIVED (likely moved from line 1)", "removed_mutants:", "  b f.go:1 SURVIVED -> - (likely moved to line 3)", "unchanged: 1"]
    assert '"fixed_survivors": []' in report.comparison_json(df, {"comparable": True}) and report.exit_code(50.0, 4, 60.0) == 10 and report.exit_code(0.0, 0, 60.0) == 0
    page = "".join(report.comparison_html(df, shifts))
    assert "<h2>new survivors</h2>" in page and "likely moved" in page
