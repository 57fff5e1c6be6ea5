"""Report documents: one JSON object a file, checked in full before a row is made of it."""

from __future__ import annotations

import json
import math
import re
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.batches import ARROW_BYTES, bound_batches
from ..functions.text import NO_SCORE, NOT_SCORED
from ..operators.verdicts import VERDICTS

TOP = ("schema_version", "tool_version", "go_version", "generated_at", "complete", "patterns", "effective_config", "bounds", "semantics", "summary", "results", "timing")
COUNTS = ("generated", "killed", "survived", "invalid", "timeout", "unknown", "unsupported", "equivalent")
NESTED = {"summary": (*COUNTS, "score", "score_text"), "timing": ("parsing_ms", "baseline_ms", "execution_ms", "rendering_ms", "total_ms")}
MUTATION = ("id", "operator", "rule_id", "span", "original", "replacement", "description", "suggestion", "diff")
SPAN = ("file", "start_byte", "end_byte", "start_line", "start_column", "end_line", "end_column")
DIAGNOSTIC = ("id", "location", "statement")
BOUNDS = ("discovered_before_bound", "retained_after_bound", "completed_mutants")


class BadReport(ValueError):
    """The document is no valid report."""


class _Number(str):
    """A number as written, unless it is a whole number of less than 19 characters."""

    __slots__ = ()


def _whole(written: str) -> int | _Number:
    return int(written) if len(written) < 19 else _Number(written)


def _need(ok: bool, problem: str) -> None:
    if not ok:
        raise BadReport(problem)


def _object(x, scope: str, keys: tuple[str, ...] = ()) -> dict:
    _need(isinstance(x, dict), f"{scope} is no object")
    for k in keys:
        _need(k in x, f"{scope} lacks {k}")
    return x


def _integer(x, scope: str) -> int:
    """A whole number written as one: neither 1.5 nor 1e0."""
    _need(type(x) is int, f"{scope} is no whole number")
    return x


def _plain(x):
    """``x`` with numbers for what was written as such; in place, as a second copy of a large document is one too many."""
    if isinstance(x, _Number):
        return int(x) if re.fullmatch(r"-?\d+", x) else float(x)
    if isinstance(x, dict | list):
        for k, v in x.items() if isinstance(x, dict) else enumerate(x):
            if type(v) is not str:
                x[k] = _plain(v)
    return x


def decode_report(text: str, schema_version: str) -> dict:
    """The report in ``text``; fails with ``BadReport`` on the first thing that is wrong with it."""
    try:
        root = json.loads(text, parse_int=_whole, parse_float=_Number, parse_constant=lambda c: _need(False, f"{c} is no number"))
    except json.JSONDecodeError as e:
        raise BadReport(f"no single JSON document: {e.msg}") from None
    _object(root, "report", ("schema_version",))
    _need(root["schema_version"] == schema_version and not isinstance(root["schema_version"], _Number), "another schema version")
    _object(root, "report", TOP)
    for k, keys in NESTED.items():
        _object(root[k], k, keys)
    _object(root["bounds"], "bounds", BOUNDS)
    results = root["results"]
    _need(results is None or isinstance(results, list), "results is no array")
    for i, r in enumerate(results or ()):
        _object(r, f"results[{i}]", ("mutation", "verdict", "diagnostic"))
        _object(r["mutation"], f"results[{i}].mutation", MUTATION)
        _object(r["mutation"]["span"], f"results[{i}].span", SPAN)
        _object(r["diagnostic"], f"results[{i}].diagnostic", DIAGNOSTIC)
    bounds = [_integer(root["bounds"][k], f"bounds.{k}") for k in BOUNDS]
    for scope, keys in (("summary", COUNTS), ("timing", NESTED["timing"])):
        for k in keys:
            _need(_integer(root[scope][k], f"{scope}.{k}") >= 0, f"{scope}.{k} is negative")
    report = _plain(root)
    _check(report, bounds)
    return report


def _check(r: dict, bounds: list[int]) -> None:
    text = lambda x: isinstance(x, str) and x.strip() != ""
    results = r["results"] or []
    _need(text(r["tool_version"]) and text(r["go_version"]), "a version is empty")
    try:
        at = datetime.fromisoformat(r["generated_at"])
    except (TypeError, ValueError):
        raise BadReport("generated_at is no time") from None
    _need(at.year > 1, "generated_at is the zero time")
    _need(isinstance(r["complete"], bool), "complete is no boolean")
    _need(isinstance(r["patterns"], list) and bool(r["patterns"]) and all(map(text, r["patterns"])), "no patterns")
    _need(isinstance(r["effective_config"], dict) and bool(r["effective_config"]), "no effective_config")
    _need(isinstance(r["semantics"], list) and bool(r["semantics"]), "no semantics")
    found, kept, done = bounds
    _need(min(bounds) >= 0 and found >= kept >= done == len(results), "bounds disagree")
    _need(not r["complete"] or kept == done, "complete, but not all was done")
    seen: set[str] = set()
    counts = dict.fromkeys(VERDICTS, 0)
    for i, x in enumerate(results):
        m, s, d = x["mutation"], x["mutation"]["span"], x["diagnostic"]
        _need(text(m["id"]) and m["id"] not in seen, f"results[{i}]: id missing or repeated")
        seen.add(m["id"])
        _need(x["verdict"] in counts, f"results[{i}]: no verdict")
        counts[x["verdict"]] += 1
        numbers = [s[k] for k in SPAN[1:]]
        _need(all(isinstance(n, int) and not isinstance(n, bool) for n in numbers), f"results[{i}]: bad span")
        b0, b1, l0, c0, l1, c1 = numbers
        _need(bool(s["file"]) and 0 <= b0 < b1 and 1 <= l0 <= l1 and c0 >= 1 and c1 >= 1, f"results[{i}]: bad span")
        _need(bool(m["operator"] and m["rule_id"] and d["id"] and d["statement"]), f"results[{i}]: a name is missing")
        _need(isinstance(x.get("duration_ms", 0), int) and x.get("duration_ms", 0) >= 0, f"results[{i}]: bad duration")
    s = r["summary"]
    _need(s["generated"] == len(results) and all(s[v.lower()] == n for v, n in counts.items()), "counts disagree with results")
    scored = counts["KILLED"] + counts["SURVIVED"]
    score = 100 * counts["KILLED"] / scored if scored else 0.0
    _need(isinstance(s["score"], int | float) and math.isfinite(s["score"]) and abs(s["score"] - score) <= 1e-8, "the score disagrees")
    _need(s["score_text"] == (f"{score:.1f}% {NOT_SCORED}" if scored else NO_SCORE), "the score's text disagrees")


def parse_reports(files: DataFrame, schema_version: str, *, path: str = "path", text: str = "text") -> DataFrame:
    """(path, report, error): one row a file, a report or what is wrong with it."""

    def run(batches):
        def take(last: int) -> pa.RecordBatch:
            n = len(good)
            out = pa.RecordBatch.from_arrays([b.column(0).slice(last - n, n), pa.array(good, pa.string()), pa.array(bad, pa.string())], ["path", "json", "error"])
            good.clear(), bad.clear()
            return out

        good: list[str | None] = []
        bad: list[str | None] = []
        for b in batches:
            size = 0
            for i, t in enumerate(b.column(1)):  # one document at a time
                try:
                    r = decode_report(t.as_py() or "", schema_version)
                    for k in ("effective_config", "bounds"):
                        r[k] = json.dumps(r[k])
                    for x in r["results"] or ():
                        x["diagnostic"]["evidence"] = json.dumps(x["diagnostic"].get("evidence"))
                    good.append(json.dumps(r)), bad.append(None)
                    r = x = None
                    size += len(good[-1])
                except BadReport as e:
                    good.append(None), bad.append(str(e))
                if size >= ARROW_BYTES:
                    yield take(i + 1)
                    size = 0
            if good:
                yield take(b.num_rows)

    bound_batches(files.sparkSession)
    rows = files.select(F.col(path).alias("path"), F.col(text).alias("text")).mapInArrow(run, "path string, json string, error string")
    return rows.select("path", F.from_json("json", schemas.REPORT).alias("report"), "error")


def read_reports(spark: SparkSession, path: str, schema_version: str) -> DataFrame:
    """(path, report) of all files at ``path``; fails if one is no valid report."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    rows = parse_reports(files, schema_version)
    if bad := rows.where(F.col("error").isNotNull()).limit(1).collect():
        raise BadReport(f"{bad[0]['path']}: {bad[0]['error']}")
    return rows.select("path", "report")


def results_of(reports: DataFrame, error: str | None = None) -> DataFrame:
    """(path, ordinal, and a result's fields flat) in document order; with ``error``, that column after path, and a row without a result for each document that has one."""
    others = () if error is None else (error,)
    explode = F.posexplode if error is None else F.posexplode_outer
    each = reports.select("path", *others, explode("report.results").alias("ordinal", "r"))
    if error is not None:
        each = each.where(F.col(error).isNotNull() | F.col("ordinal").isNotNull())
    return each.select("path", *others, F.col("ordinal").cast("long").alias("ordinal"), "r.mutation.*", "r.mutation.span.*", *(f"r.{k}" for k in ("verdict", "responsible_tests", "responsible_assertions", "responsible_panics", "covered_by_selected_tests", "coverage_known", "cached", "duration_ms"))).drop("span")
