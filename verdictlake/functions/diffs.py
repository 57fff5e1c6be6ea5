"""Unified diffs: writing one for a replacement, and reading changed lines out of one."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

NO_NEWLINE = "\\ No newline at end of file"
_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
_META = ("Binary files ", "index ", "old mode ", "new mode ", "new file mode ", "deleted file mode ", "similarity index ", "dissimilarity index ", "rename from ", "rename to ", "copy from ", "copy to ")


class BadDiff(ValueError):
    """The text is no well-formed diff."""


def quoted_path(path: str) -> str:
    """The path as a diff header shows it: quoted where it holds quotes, backslashes, controls or non-ASCII bytes."""
    if all(0x20 <= ord(c) < 0x7F and c not in '"\\' for c in path):
        return path
    out = []
    for b in path.encode():
        c = chr(b)
        out.append({"\n": "\\n", "\t": "\\t", "\r": "\\r", '"': '\\"', "\\": "\\\\"}.get(c) or (c if 0x20 <= b < 0x7F else f"\\{b:03o}"))
    return '"' + "".join(out) + '"'


def path_of(header: str, prefix: str) -> str | None:
    """The path in a ``---`` or ``+++`` header; None for the null device."""
    name = header.split("\t")[0] if not header.startswith('"') else header
    if name.startswith('"'):
        if len(name) < 2 or not name.rstrip().endswith('"'):
            raise BadDiff("an open quote in a path")
        name = codecs.escape_decode(name.rstrip()[1:-1].encode())[0].decode("utf-8", "surrogateescape")
    if name == "/dev/null":
        return None
    if not name.startswith(prefix) or len(name) == len(prefix):
        raise BadDiff(f"a path without {prefix}")
    return name[len(prefix) :]


def unified_diff(path: str, source: bytes, start: int, end: int, replacement: bytes) -> str:
    """The diff, without context, that puts ``replacement`` in place of the bytes from ``start`` to ``end``."""
    first = source.rfind(b"\n", 0, start) + 1
    stop = source.find(b"\n", max(end - 1, start)) if end > start else source.find(b"\n", start)
    if end > start and source[end - 1 : end] == b"\n":
        stop = source.find(b"\n", end)
    stop = len(source) if stop < 0 else stop + 1
    old, new = source[first:stop], source[first:start] + replacement + source[end:stop]
    line = source.count(b"\n", 0, first) + 1

    def block(sign: str, data: bytes) -> tuple[list[str], int]:
        lines = data.decode("utf-8", "surrogateescape").split("\n")
        tail = [] if lines[-1] == "" else [NO_NEWLINE]
        lines = lines[:-1] if lines[-1] == "" else lines
        return [sign + x for x in lines] + tail, len(lines)

    (minus, a), (plus, b) = block("-", old), block("+", new)
    at = lambda n: f"{line if n else line - 1},{n}" if n != 1 else str(line)
    return "\n".join([f"--- {quoted_path('a/' + path)}", f"+++ {quoted_path('b/' + path)}", f"@@ -{at(a)} +{at(b)} @@", *minus, *plus]) + "\n"


def apply_unified(source: bytes, diff: str) -> bytes:
    """``source`` with the hunks of a single-file diff applied; fails where removed lines are not the source's."""
    old = source.decode("utf-8", "surrogateescape").split("\n")
    out: list[str] = []
    at = 0
    rows = diff.split("\n")
    i, end_old, end_new = 0, None, None
    while i < len(rows):
        m = _HUNK.match(rows[i])
        i += 1
        if not m:
            continue
        n_old, n_new = (1 if g is None else int(g) for g in (m[2], m[4]))
        begin = int(m[1]) - (1 if n_old else 0)
        out += old[at:begin]
        at = begin
        while n_old or n_new or (i < len(rows) and rows[i] == NO_NEWLINE):
            row = rows[i]
            i += 1
            if row == NO_NEWLINE:
                if rows[i - 2][0] == "-":
                    end_old = True
                else:
                    end_new = True
            elif row[:1] == "-":
                if old[at] != row[1:]:
                    raise BadDiff(f"line {at + 1} is not what the diff removes")
                at, n_old = at + 1, n_old - 1
            elif row[:1] == "+":
                out.append(row[1:])
                n_new -= 1
            else:
                out.append(old[at])
                at, n_old, n_new = at + 1, n_old - 1, n_new - 1
    rest = old[at:]
    if end_new and not any(rest):
        rest = []
    elif end_old and not end_new and not rest:
        rest = [""]
    return "\n".join(out + rest).encode("utf-8", "surrogateescape")


def _count(text: str | None) -> int:
    return 1 if text is None else int(text)


class _File:
    """What has been seen of one file's section."""

    def __init__(self) -> None:
        self.path: str | None = None
        self.old = self.new = self.hunk = self.meta = self.binary = False

    def close(self, left: tuple[int, int]) -> None:
        if self.old != self.new:
            raise BadDiff("one file header without the other")
        if not (self.old or self.meta):
            raise BadDiff("a file without headers or metadata")
        if any(left):
            raise BadDiff("a hunk ends too early")


def changed_lines(diff: str) -> Iterator[tuple[str, int]]:
    """(file, line) of all new-side lines of a git diff's hunks; hunk payload is counted off before headers are looked for."""
    if not diff.strip():
        return
    now: _File | None = None
    minus = plus = 0
    lines = diff.split("\n")
    if lines[-1] == "":
        lines.pop()
    for text in (x.removesuffix("\r") for x in lines):
        if minus or plus:
            if text == NO_NEWLINE:
                continue
            sign = text[:1]
            if sign not in ("+", "-", " ") or not sign:
                raise BadDiff(f"no hunk line: {text!r}")
            minus, plus = minus - (sign != "+"), plus - (sign != "-")
            if minus < 0 or plus < 0:
                raise BadDiff("a hunk is longer than it says")
        elif text.startswith("diff --git "):
            if now:
                now.close((minus, plus))
            now = _File()
        elif now is None:
            raise BadDiff("text before the first file")
        elif now.binary or (text == NO_NEWLINE and now.hunk):
            continue
        elif text.startswith("--- "):
            if now.old or now.new or now.hunk:
                raise BadDiff("a second --- header")
            path_of(text[4:], "a/")
            now.old = True
        elif text.startswith("+++ "):
            if not now.old or now.new:
                raise BadDiff("+++ without ---")
            now.path, now.new = path_of(text[4:], "b/"), True
        elif text.startswith("@@"):
            m = _HUNK.match(text)
            if not now.new or m is None:
                raise BadDiff(f"a bad hunk header: {text!r}")
            start, minus, plus, now.hunk = int(m[3]), _count(m[2]), _count(m[4]), True
            if now.path is not None:
                yield from ((now.path, start + i) for i in range(plus))
        elif text == "GIT binary patch":
            now.binary = now.meta = True
        elif text.startswith(_META):
            now.meta = now.meta or not text.startswith("index ")
        else:
            raise BadDiff(f"an unknown line: {text!r}")
    if now is None:
        raise BadDiff("no file")
    now.close((minus, plus))


def splice(source: bytes, start: int, end: int, original: bytes, replacement: bytes) -> bytes:
    """``source`` with ``replacement`` at the span, which must hold ``original``."""
    if not 0 <= start <= end <= len(source) or source[start:end] != original:
        raise ValueError("the span does not hold the original text")
    return source[:start] + replacement + source[end:]
