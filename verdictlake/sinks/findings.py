"""Findings for code-scanning tools: rules and results as tables, and the documents made of them."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_data, escape_property
from ..operators.verdicts import actionable, level

MESSAGES = {"SURVIVED": "No selected test noticed this change: ", "TIMEOUT": "The tests ran out of time on this change: ", "UNKNOWN": "The tests gave no verdict on this change: "}


def message(verdict: Column, description: Column) -> Column:
    return F.concat(F.try_element_at(F.create_map(*(F.lit(x) for kv in MESSAGES.items() for x in kv)), verdict), description)


def rules(rows: DataFrame, *, rule: str = "rule_id", description: str = "description", seq: str = "seq", verdict: str = "verdict") -> DataFrame:
    """(rule_id, description) of the rules of all findings, each with the description that came first."""
    return rows.where(actionable(F.col(verdict))).groupBy(rule).agg(F.min_by(description, seq).alias("description"))


def results(rows: DataFrame, *, description: str = "description", verdict: str = "verdict") -> DataFrame:
    return rows.where(actionable(F.col(verdict))).withColumns({"level": level(F.col(verdict)), "message": message(F.col(verdict), F.col(description))})


def sarif_pieces(rows: DataFrame, *, tool: str, version: str) -> Iterator[str]:
    """A SARIF 2.1.0 document piece by piece; findings come in the order of ``seq``, one at a time."""
    known = [{"id": r["rule_id"], "shortDescription": {"text": r["description"]}} for r in rules(rows).orderBy("rule_id").collect()]
    driver = json.dumps({"name": tool, "version": version, "rules": known}, indent=2)
    yield f'{{\n"$schema": "https://json.schemastore.org/sarif-2.1.0.json",\n"version": "2.1.0",\n"runs": [{{"tool": {{"driver": {driver}}},\n"results": ['
    for i, r in enumerate(results(rows).orderBy("seq").toLocalIterator()):
        place = {"physicalLocation": {"artifactLocation": {"uri": r["file"]}, "region": {"startLine": r["start_line"]}}}
        yield (",\n" if i else "\n") + json.dumps({"ruleId": r["rule_id"], "level": r["level"], "message": {"text": r["message"]}, "locations": [place]})
    yield "\n]}]\n}\n"


def sarif(rows: DataFrame, *, tool: str, version: str) -> str:
    return "".join(sarif_pieces(rows, tool=tool, version=version))


def annotations(rows: DataFrame) -> DataFrame:
    """(seq, command): one workflow command for each finding."""
    kind = level(F.col("verdict"), other="notice")
    command = F.concat(
        F.lit("::"), kind, F.lit(" file="), escape_property(F.col("file")), F.lit(",line="), F.coalesce(F.col("start_line"), F.lit(1)).cast("string"),
        F.lit(",title="), escape_property(F.col("rule_id")), F.lit("::"), escape_data(message(F.col("verdict"), F.col("description"))),
    )
    return rows.where(actionable(F.col("verdict"))).select("seq", command.alias("command"))
