"""Report renderers: text, JSON, HTML; results stream to the driver in order."""

from __future__ import annotations

import html
import json
import time
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import findings

FORMATS = ("text", "json", "html", "sarif", "github")


def assertion_text(a: dict) -> str:
    place = f"{a['file']}:{a['line']}" if a.get("file") and a.get("line") else a.get("file") or ""
    return ": ".join(x for x in (a.get("test"), place, a.get("message")) if x)


def result_lines(x: dict) -> Iterator[str]:
    covered = "coverage: unknown" if not x.get("coverage_known") else "coverage: covered" if x.get("covered_by_selected_tests") else "coverage: not covered"
    yield f"{x['verdict']} {x['id']} {x['file']}:{x['start_line']}:{x['start_column']} {x['description']}{' [cached]' if x.get('cached') else ''}"
    yield f"  {covered}"
    if x.get("responsible_tests"):
        yield "  killed by: " + ", ".join(x["responsible_tests"])
    yield from ("  assertion: " + assertion_text(a) for a in x.get("responsible_assertions") or ())
    yield from (f"  crashed: {p['test']}: {p['message']}" for p in x.get("responsible_panics") or ())
    if x["verdict"] == "SURVIVED":
        yield f"  suggested test: {x.get('suggestion') or ''}"
        yield from ("    " + line for line in (x.get("diff") or "").removesuffix("\n").split("\n"))
    if x["verdict"] == "EQUIVALENT":
        yield f"  proof: {x.get('equivalent_reason') or ''}"


def text_report(header: dict, results: Iterable[dict], *, tool: str) -> Iterator[str]:
    b = header.get("bounds") or {}
    yield f"{tool} {header['tool_version']} ({'complete' if header['complete'] else 'INCOMPLETE'})"
    yield "patterns: " + " ".join(header["patterns"])
    yield f"bound: max_mutants={b.get('max_mutants')}, timeout={b.get('per_mutant_timeout')}"
    yield ""
    for x in results:
        yield from result_lines(x)
    if header.get("warnings"):
        yield from ("", "warnings", *(f"  - {w}" for w in header["warnings"]))
    s, t = header["summary"], header["timing"]
    yield from ("", "summary", f"  {s['generated']} mutants generated")
    yield "  " + ", ".join(f"{s[k]} {k}" for k in ("killed", "survived", "invalid", "timeout", "unknown", "unsupported", "equivalent"))
    yield f"  score: {s['score_text']}"
    yield f"timing: parse={t['parsing_ms']}ms baseline={t['baseline_ms']}ms mutants={t['execution_ms']}ms render={t['rendering_ms']}ms total={t['total_ms']}ms"


#: Sections of the HTML report, what needs a look first.
SECTIONS = {
    "SURVIVED": "Survivors: no selected test noticed", "TIMEOUT": "Out of time", "UNKNOWN": "No verdict", "KILLED": "Noticed by a test", "INVALID": "Do not compile", "UNSUPPORTED": "Not supported", "EQUIVALENT": "Proved to change nothing",
}
_STYLE = "body{font:15px sans-serif;max-width:70em;margin:2em auto}pre{background:#f4f4f4;padding:.6em;overflow:auto}dt{font-weight:bold}.counts td{padding:.2em .8em}.SURVIVED{border-left:4px solid #c33;padding-left:.8em}"


def _escaped(x: object) -> str:
    return html.escape("" if x is None else str(x))


def _page(title: str) -> str:
    return f"<!DOCTYPE html><html lang='en'><head><meta charset='utf-8'><title>{_escaped(title)}</title><style>{_STYLE}</style></head><body><h1>{_escaped(title)}</h1>"


def _result_html(x: dict) -> Iterator[str]:
    e = _escaped
    covered = "unknown" if not x.get("coverage_known") else "covered" if x.get("covered_by_selected_tests") else "not covered"
    yield f"<article class='{e(x['verdict'])}' id='{e(x['id'])}'><h3>{e(x['file'])}:{e(x['start_line'])}:{e(x.get('start_column'))} {e(x['description'])}</h3><dl>"
    told = {"id": x["id"], "rule": x.get("rule_id"), "coverage": covered, "reused": "yes" if x.get("cached") else None, "tests": ", ".join(x.get("responsible_tests") or ()), "proof": x.get("equivalent_reason") if x["verdict"] == "EQUIVALENT" else None}
    told["suggested test"] = x.get("suggestion") if x["verdict"] == "SURVIVED" else None
    yield from (f"<dt>{e(k)}</dt><dd>{e(v)}</dd>" for k, v in told.items() if v)
    yield from (f"<dt>assertion</dt><dd>{e(assertion_text(a))}</dd>" for a in x.get("responsible_assertions") or ())
    yield from (f"<dt>crash</dt><dd>{e(p['test'])}: {e(p['message'])}</dd>" for p in x.get("responsible_panics") or ())
    yield "</dl>" + (f"<pre>{e(x['diff'])}</pre>" if x.get("diff") else "") + "</article>"


def html_report(header: dict, results: Iterable[dict], *, tool: str) -> Iterator[str]:
    """A page with the score, the counts, a section for each verdict that occurs, warnings, terms and times. ``results`` come by section, as ``render`` sorts them."""
    e, s, b = _escaped, header["summary"], header.get("bounds") or {}
    yield _page(f"{tool} {header['tool_version']}")
    yield "" if header["complete"] else "<p><strong>Incomplete: the run was interrupted.</strong></p>"
    yield f"<p>Score: {e(s['score_text'])}</p><table class='counts'><tr>" + "".join(f"<td>{e(k)}: {e(s[k])}</td>" for k in ("generated", "killed", "survived", "invalid", "timeout", "unknown", "unsupported", "equivalent")) + "</tr></table>"
    yield f"<p>Patterns: {e(' '.join(header['patterns']))}</p><dl>" + "".join(f"<dt>{e(k)}</dt><dd>{e(v)}</dd>" for k, v in sorted(b.items())) + "</dl>"
    last = None
    for x in results:
        if x["verdict"] != last:
            last = x["verdict"]
            yield f"<h2 id='{e(last)}'>{e(SECTIONS.get(last, last))}</h2>"
        yield from _result_html(x)
    for title, items in (("Warnings", header.get("warnings")), ("Terms", header.get("semantics"))):
        if items:
            yield f"<h2>{title}</h2><ul>" + "".join(f"<li>{e(w)}</li>" for w in items) + "</ul>"
    yield "<h2>Times</h2><dl>" + "".join(f"<dt>{e(k)}</dt><dd>{e(v)} ms</dd>" for k, v in header["timing"].items()) + "</dl></body></html>"


class Sticky:
    """A writer that stops at its first failure and keeps it, so that renderers need not look after each write."""

    def __init__(self, write: Callable[[str], object]):
        self.write, self.error, self.characters = write, None, 0

    def __call__(self, text: str) -> None:
        if self.error is None:
            try:
                self.write(text)
                self.characters += len(text)
            except OSError as e:
                self.error = e


def measured(produce: Callable[[dict, Callable[[str], object]], object], header: dict, write: Callable[[str], object], clock: Callable[[], float] = time.monotonic) -> dict:
    """Render twice: once into nothing for the time that rendering takes, once with that time in the header; gives the header as written."""
    began = clock()
    produce(header, lambda text: None)
    took = int((clock() - began) * 1000)
    timing = header["timing"] | {"rendering_ms": took, "total_ms": header["timing"]["total_ms"] + took}
    produce(header | {"timing": timing}, write)
    return header | {"timing": timing}


def progress_line(done: int, total: int, result: dict) -> str:
    return f"[{done}/{total}] {result['verdict']} {result['id']} {result['file']}:{result['start_line']}"


def render(results: DataFrame, header: dict, form: str, write: Callable[[str], object], *, tool: str) -> None:
    """Write the report of flat ``results`` (with ``ordinal``) in one of ``FORMATS``."""
    ordered = results.orderBy("ordinal")
    rows = (r.asDict(recursive=True) for r in ordered.toLocalIterator())
    if form == "text":
        for line in text_report(header, rows, tool=tool):
            write(line + "\n")
    elif form == "json":
        write(json.dumps({k: v for k, v in header.items() if k != "results"}, indent=2)[:-2] + ',\n  "results": [')
        for i, r in enumerate(rows):
            write((",\n" if i else "\n") + json.dumps(r, indent=2))
        write("\n  ]\n}\n")
    elif form == "html":
        place = F.coalesce(F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("verdict")), F.lit(0))
        sections = results.orderBy(F.when(place > 0, place).otherwise(len(SECTIONS) + 1), "verdict", "ordinal")
        for line in html_report(header, (r.asDict(recursive=True) for r in sections.toLocalIterator()), tool=tool):
            write(line + "\n")
    elif form == "sarif":
        for piece in findings.sarif_pieces(results.withColumnRenamed("ordinal", "seq"), tool=tool, version=header["tool_version"]):
            write(piece)
    elif form == "github":
        for r in findings.annotations(results.withColumnRenamed("ordinal", "seq")).orderBy("seq").toLocalIterator():
            write(r["command"] + "\n")
    else:
        raise ValueError(f"an unknown format: {form}")


BUCKETS = ("new_survivors", "fixed_survivors", "still_open", "reclassified", "removed_mutants")


def _noted(compared: DataFrame, shifts: DataFrame | None) -> DataFrame:
    """What has changed, in order of bucket and place, with ``note`` on both ids of a pair that has likely moved."""
    rows = compared.where("bucket <> 'unchanged'")
    if shifts is None:
        rows = rows.withColumn("note", F.lit(""))
    else:
        said = lambda key, way, line: shifts.select(F.col(key).alias("_id"), F.concat(F.lit(f" (likely moved {way} line "), F.col(line).cast("string"), F.lit(")")).alias("note"))
        notes = said("removed_id", "to", "new_line").unionByName(said("new_id", "from", "old_line")).groupBy("_id").agg(F.max("note").alias("note"))
        rows = rows.join(notes, F.col("id") == F.col("_id"), "left").drop("_id").withColumn("note", F.coalesce("note", F.lit("")))
    return rows.orderBy("bucket", "file", "start_line", "start_column", "id")


def comparison_text(compared: DataFrame, shifts: DataFrame | None = None) -> Iterator[str]:
    """Sections by bucket in order of place, a shifted pair noted on both of its ids; unchanged ids are only counted."""
    last = None
    for r in _noted(compared, shifts).toLocalIterator():
        if r["bucket"] != last:
            last = r["bucket"]
            yield f"{last}:"
        yield f"  {r['id']} {r['file']}:{r['start_line']} {r['baseline_verdict'] or '-'} -> {r['current_verdict'] or '-'}{r['note']}"
    yield f"unchanged: {compared.where('bucket = \"unchanged\"').count()}"


def comparison_html(compared: DataFrame, shifts: DataFrame | None = None, *, header: dict | None = None) -> Iterator[str]:
    """A page with the counts of all buckets, the header's fields and a table for each bucket that is not empty."""
    e = _escaped
    counts = {r["bucket"]: r["count"] for r in compared.groupBy("bucket").count().collect()}
    yield _page("Comparison")
    yield "<table class='counts'><tr>" + "".join(f"<td>{b.replace('_', ' ')}: {counts.get(b, 0)}</td>" for b in (*BUCKETS, "unchanged")) + "</tr></table>"
    yield "<dl>" + "".join(f"<dt>{e(k)}</dt><dd>{e(v)}</dd>" for k, v in (header or {}).items()) + "</dl>"
    last = None
    for r in _noted(compared, shifts).toLocalIterator():
        if r["bucket"] != last:
            yield ("</table>" if last else "") + f"<h2>{e(r['bucket'].replace('_', ' '))}</h2><table><tr><th>id</th><th>place</th><th>baseline</th><th>current</th><th></th></tr>"
            last = r["bucket"]
        yield f"<tr><td>{e(r['id'])}</td><td>{e(r['file'])}:{e(r['start_line'])}</td><td>{e(r['baseline_verdict'] or '-')}</td><td>{e(r['current_verdict'] or '-')}</td><td>{e(r['note'].strip())}</td></tr>"
    yield ("</table>" if last else "") + "</body></html>"


def comparison_json_pieces(compared: DataFrame, header: dict) -> Iterator[str]:
    """A comparison as JSON, piece by piece: all buckets in order of place, empty ones as empty arrays, and the number of unchanged ids."""
    yield json.dumps({**header, "unchanged": compared.where("bucket = 'unchanged'").count()}, indent=2)[:-2]
    for bucket in BUCKETS:
        yield f',\n  "{bucket}": ['
        first = True
        for r in compared.where(F.col("bucket") == bucket).orderBy("file", "start_line", "start_column", "id").toLocalIterator():
            yield ("" if first else ",") + "\n    " + json.dumps(r.asDict(recursive=True), default=str)
            first = False
        yield "]" if first else "\n  ]"
    yield "\n}\n"


def comparison_json(compared: DataFrame, header: dict) -> str:
    return "".join(comparison_json_pieces(compared, header))


def exit_code(score: float, scored: int, minimum: float, failing: int = 10) -> int:
    return failing if scored > 0 and score < minimum else 0
