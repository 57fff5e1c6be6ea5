"""Flat settings files: ``key = value`` or ``key: value``, with quotes, comments and lists."""

from __future__ import annotations

import json
import re
from pathlib import Path

FAMILIES = ("boundary", "boolean", "connective", "arithmetic", "relational", "returnvalue", "condition", "errorreturn", "statement", "bounds", "switch", "loop", "assignment", "literal", "channel")
DEFAULTS = {
    "operators": ["boundary", "boolean"], "max_mutants": 0, "timeout": "30s", "preparation_timeout": "0s", "total_timeout": "0s", "format": "text", "ci_min_score": 0.0, "ci_exit_code": 10,
    "workers": 0, "test_run": "", "cache_dir": "", "git_base": "", "coverage_test_selection": False, "narrow_test_scope": False, "include_generated": False,
}
_PART = re.compile(r"""\s*("(?:[^"\\]|\\.)*"|'[^']*'|[^,'"]*)\s*(?:,|$)""")


class BadSettings(ValueError):
    """A settings file cannot be used."""


def _bare(line: str) -> str:
    """The line without its comment."""
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote and line[i - 1] != "\\" else quote
        elif c in "\"'":
            quote = c
        elif c == "#":
            return line[:i]
    if quote:
        raise BadSettings("an open quote")
    return line


def _unquoted(value: str) -> str:
    if len(value) > 1 and value[0] == value[-1] == "'":
        return value[1:-1]
    if len(value) > 1 and value[0] == value[-1] == '"':
        return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1])
    return value


def _list(value: str) -> list[str]:
    inner = value[1:-1] if value.startswith("[") and value.endswith("]") else value
    return [x for x in (_unquoted(m[1].strip()) for m in _PART.finditer(inner)) if x]


def duration_seconds(text: str) -> float:
    parts = re.findall(r"(\d+(?:\.\d+)?)(ns|us|µs|ms|s|m|h)", text)
    if not parts or "".join(a + b for a, b in parts) != text.lstrip("+-"):
        if text == "0":
            return 0.0
        raise BadSettings(f"no duration: {text}")
    unit = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1, "m": 60, "h": 3600}
    return sum(float(a) * unit[b] for a, b in parts) * (-1 if text.startswith("-") else 1)


def _typed(key: str, value: str | list[str]):
    default = DEFAULTS.get(key)
    if key not in DEFAULTS:
        raise BadSettings(f"an unknown key: {key}")
    if isinstance(default, list):
        return value if isinstance(value, list) else _list(value)
    if isinstance(value, list):
        raise BadSettings(f"{key} takes one value")
    text = _unquoted(value)
    try:
        if isinstance(default, bool):
            return {"true": True, "false": False}[text]
        return type(default)(text)
    except (KeyError, ValueError):
        raise BadSettings(f"{key}: no {type(default).__name__}: {text}") from None


def parse_settings(text: str, *, yaml: bool = False, base: dict | None = None) -> dict:
    out, sep, lines, i = dict(base or DEFAULTS), ":" if yaml else "=", text.splitlines(), 0
    while i < len(lines):
        raw = _bare(lines[i])
        i += 1
        line = raw.strip()
        if not line:
            continue
        if line[0] in "[{-":
            raise BadSettings(f"line {i}: nested settings")
        key, found, value = line.partition(sep)
        key, value = key.strip(), value.strip()
        if not found or not key or (sep in re.sub(r"\"[^\"]*\"|'[^']*'", "", value)):
            raise BadSettings(f"line {i}: one key and one value are needed")
        if yaml and not value:
            items = []
            while i < len(lines) and re.match(r"\s+-\s", _bare(lines[i]) + " "):
                items.append(_unquoted(_bare(lines[i]).strip()[1:].strip()))
                i += 1
            if not items:
                raise BadSettings(f"line {i}: {key} has no value")
            out[key] = _typed(key, items)
        elif not value:
            raise BadSettings(f"line {i}: {key} has no value")
        else:
            out[key] = _typed(key, value)
    check_settings(out)
    return out


def check_settings(s: dict) -> None:
    bad = [x for x in s["operators"] if x not in FAMILIES]
    checks = (
        (bool(s["operators"]), "no operators"), (not bad, f"unknown operators: {bad}"), (duration_seconds(s["timeout"]) > 0, "timeout must be above 0"),
        (min(duration_seconds(s["preparation_timeout"]), duration_seconds(s["total_timeout"])) >= 0, "a time limit is negative"),
        (s["format"] in ("text", "json", "html", "sarif", "github"), "an unknown format"), (s["max_mutants"] >= 0, "max_mutants is negative"),
        (0 <= s["ci_min_score"] <= 100, "ci_min_score is no percentage"), (0 < s["ci_exit_code"] <= 125, "ci_exit_code is out of range"), (s["workers"] >= 0, "workers is negative"),
    )
    for ok, problem in checks:
        if not ok:
            raise BadSettings(problem)


def effective_settings(s: dict) -> str:
    """The settings in force as JSON, all keys in order of their names."""
    check_settings(s)
    return json.dumps(DEFAULTS | s, indent=2, sort_keys=True, ensure_ascii=False)


def find_settings(start: str, names: tuple[str, ...], stop: str = "go.mod") -> dict:
    """The first of ``names`` on the way up to the folder that holds ``stop``; the defaults without one."""
    at = Path(start).resolve()
    for folder in (at, *at.parents):
        for name in names:
            if (folder / name).is_file():
                return parse_settings((folder / name).read_text(), yaml=name.lower().endswith((".yaml", ".yml")))
        if (folder / stop).exists():
            break
    return dict(DEFAULTS)
