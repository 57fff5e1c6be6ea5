"""Score histories: append one entry, render the trend."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import one_decimal

COUNTS = ("generated", "killed", "survived", "invalid", "timeout", "unknown", "unsupported", "equivalent")


def entry_of(report: dict, label: str, time: str) -> dict:
    """The history entry of a report: its summary, bounds and the settings that decide comparability. Bounds of a wrong type count 0."""
    bounds, config = report.get("bounds") or {}, report.get("effective_config") or {}
    number = lambda k: bounds[k] if isinstance(bounds.get(k), int) and not isinstance(bounds.get(k), bool) else 0
    text = lambda k: config[k] if isinstance(config.get(k), str) else ""
    return {
        "time": time, "label": label, "score": report["summary"]["score"], "score_text": report["summary"]["score_text"], **{k: report["summary"][k] for k in COUNTS},
        "complete": report["complete"], **{k: number(k) for k in ("discovered_before_bound", "retained_after_bound", "completed_mutants")}, "patterns": report["patterns"],
        "test_working_directory": text("test_working_directory"), "operator_semantics": text("operator_semantics"),
        **{k: config.get(k) for k in ("operators", "test_run", "coverage_test_selection", "narrow_test_scope")},
    }


def append_entry(path: str, entry: dict) -> None:
    """One line of JSON at the end of the file."""
    with Path(path).open("a", encoding="utf-8") as f:
        f.write(json.dumps(entry, ensure_ascii=False) + "\n")


def append_journal(path: str, *, time: str, reason: str, patterns: list[str], completed: int, retained: int) -> None:
    """A line for a run that was interrupted; the folder is made if it is not there."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    append_entry(path, {"time": time, "reason": reason, "patterns": patterns, "completed_mutants": completed, "retained_after_bound": retained, "complete": completed == retained})


def trend_lines(history: DataFrame) -> DataFrame:
    """``history`` with ``line``: the label padded to the longest (in bytes), two spaces, the score with one decimal."""
    widest = history.agg(F.max(F.octet_length("label")).alias("w")).scalar()
    return history.withColumn("line", F.concat(F.rpad("label", widest, F.lit(" ")), F.lit("  "), one_decimal(F.col("score")), F.lit("%")))


def trend_text(history: DataFrame, order: str = "line_no") -> str:
    """The trend in file order; a history is small enough for one screen and so for the driver."""
    return "".join(r["line"] + "\n" for r in trend_lines(history).orderBy(order).select("line").toLocalIterator())


def trend_json(entries: list[dict]) -> str:
    return json.dumps(entries, ensure_ascii=False, indent=2)
