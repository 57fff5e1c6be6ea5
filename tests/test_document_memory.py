"""Whole documents on their way to and in Python workers."""

import json
import tracemalloc

from pyspark.sql import functions as F

from verdictlake import catalogue
from verdictlake.functions.batches import ARROW_BYTES
from verdictlake.sources import diffs, reports

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def document(n: int, **changed) -> str:
    span = {"file": "f.go", "start_byte": 0, "end_byte": 1, "start_line": 1, "start_column": 1, "end_line": 1, "end_column": 2}
    result = lambda i: {"mutation": {k: "x" for k in reports.MUTATION} | {"id": f"M-{i}", "span": span}, "verdict": "KILLED", "diagnostic": {"id": "d", "location": span, "statement": "s"}}
    counts = dict.fromkeys(reports.COUNTS, 0) | {"generated": n, "killed": n, "score": 100.0 if n else 0.0, "score_text": f"100.0% {reports.NOT_SCORED}" if n else reports.NO_SCORE}
    head = {"schema_version": "v", "tool_version": "1", "go_version": "1", "generated_at": "2024-01-02T03:04:05Z", "complete": True, "patterns": ["p"], "effective_config": {"max": 1.5, "of": [1, {"a": 2}]}, "bounds": dict.fromkeys(reports.BOUNDS, n), "semantics": ["s"]}
    return json.dumps(head | {"summary": counts, "results": [result(i) for i in range(n)], "timing": dict.fromkeys(reports.NESTED["timing"], 0)} | changed)


def test_a_large_report_is_held_once():
    text = document(3000)
    tracemalloc.start()
    found = reports.decode_report(text, "v")
    kept, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert found == json.loads(text) and type(found["effective_config"]["of"][1]["a"]) is int
    assert peak < 1.6 * kept


def test_batches_of_documents_are_bounded(spark):
    before = spark.conf.get(KEY)
    try:
        for call in (lambda: reports.parse_reports(spark.range(1).select(F.lit("p").alias("path"), F.lit("").alias("text")), "v"), lambda: diffs.parse_diffs(spark.range(1).select("id", F.lit("").alias("diff")))):
            spark.conf.set(KEY, str(64 << 20))
            call()
            assert int(spark.conf.get(KEY).removesuffix("b")) <= ARROW_BYTES
        spark.conf.set(KEY, "1m")
        diffs.parse_diffs(spark.range(1).select("id", F.lit("").alias("diff")))
        assert spark.conf.get(KEY) in ("1m", "1048576b")
    finally:
        spark.conf.set(KEY, before)


def test_batches_in_and_out_keep_each_document_with_its_path(spark):
    texts = [document(i % 7) if i % 3 else document(1, complete=1) if i % 2 else "{" for i in range(60)]
    files = spark.createDataFrame(list(enumerate(texts)), "path long, text string").select(F.col("path").cast("string").alias("path"), "text").coalesce(1)
    before = spark.conf.get(KEY)
    try:
        spark.conf.set(KEY, "20000")
        found = reports.parse_reports(files, "v").collect()
    finally:
        spark.conf.set(KEY, before)
    assert [r["path"] for r in found] == [str(i) for i in range(60)]
    for i, r in enumerate(found):
        wrong = None if i % 3 else "complete is no boolean" if i % 2 else "no single JSON document"
        assert (r["error"] or "").startswith(wrong or "") and (r["error"] is None) == (wrong is None) == (r["report"] is not None)
        assert r["report"] is None or len(r["report"]["results"]) == i % 7
    rows = reports.results_of(spark.createDataFrame(found, reports.parse_reports(files, "v").schema), "error").collect()
    expected = [(str(i), k, f"M-{k}", True) for i in range(60) if i % 3 for k in range(i % 7)] + [(str(i), None, None, False) for i in range(0, 60, 3)]
    assert sorted(str((r["path"], r["ordinal"], r["id"], r["error"] is None)) for r in rows) == sorted(map(str, expected))


def test_documents_are_parsed_once(spark, sf):
    plan = catalogue.queries()["report_documents"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
