"""Mutation candidates from Go source text, as a table-generating function.

A lexer and bracket matching stand in for a parser, and scopes are judged by name:
a file that declares a ``true`` or ``false`` of its own gets no mutations of those.
Two proofs of equivalence are made (``structure``), both on exact shapes; results
that every call site discards are left to ``operators.discards``, which sees all files.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import structure
from .batches import bound_batches
from .diffs import unified_diff

FAMILIES = ("boundary", "boolean", "connective", "arithmetic", "relational", "returnvalue", "condition", "errorreturn", "statement", "bounds", "switch", "loop", "assignment", "literal", "channel")
DEFAULT_FAMILIES = ("boundary", "boolean")
_LEXEMES = {
    "space": rb"[ \t\r\n]+", "comment": rb"//[^\n]*|/\*.*?\*/", "string": rb"\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`", "char": rb"'(?:[^'\\\n]|\\.)+'",
    "number": rb"0[xXbBoO][0-9a-fA-F_]+|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?i?|\d[\d_]*\.?(?:[eE][+-]?\d+)?i?", "name": rb"[A-Za-z_\x80-\xff][A-Za-z0-9_\x80-\xff]*",
    "op": rb"<<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^<>=!()\[\]{},;.:~]",
}
_TOKEN = re.compile(b"|".join(b"(?P<%s>%s)" % (k.encode(), x) for k, x in _LEXEMES.items()), re.S)
_KEYWORDS = {b"break", b"case", b"chan", b"const", b"continue", b"default", b"defer", b"else", b"fallthrough", b"for", b"func", b"go", b"goto", b"if", b"import", b"interface", b"map", b"package", b"range", b"return", b"select", b"struct", b"switch", b"type", b"var"}
_OPEN, _CLOSE = {b"(", b"[", b"{"}, {b")", b"]", b"}"}
_SWAPS = {
    "boundary": {b"<": b"<=", b"<=": b"<", b">": b">=", b">=": b">"}, "arithmetic": {b"+": b"-", b"-": b"+", b"*": b"/", b"/": b"*"}, "relational": {b"==": b"!=", b"!=": b"=="},
    "connective": {b"&&": b"||", b"||": b"&&"}, "incdec": {b"++": b"--", b"--": b"++"}, "assign": {b"+=": b"-=", b"-=": b"+=", b"*=": b"/=", b"/=": b"*="},
}
_INT64 = (1 << 63) - 1
OUT_ROWS = 4096
SHARES = 3  #: partitions for each core


class Token(NamedTuple):
    kind: str
    text: bytes
    start: int
    end: int


class Candidate(NamedTuple):
    family: str
    rule: str
    start: int
    end: int
    replacement: bytes
    description: str
    suggestion: str = ""
    equivalent: str | None = None


def tokens(source: bytes) -> list[Token]:
    """The tokens but for white space and comments; a byte that starts none ends the list early with ``ValueError``."""
    out, at = [], 0
    for m in _TOKEN.finditer(source):
        start, end = m.span()
        if start != at:
            break
        kind, at = m.lastgroup, end
        if kind not in ("space", "comment"):
            text = m[0]
            out.append(Token("keyword" if text in _KEYWORDS else kind, text, start, end))
    if at < len(source):
        raise ValueError(f"no token at byte {at}")
    return out


def _partners(t: list[Token]) -> dict[int, int]:
    stack, out = [], {}
    for i, x in enumerate(t):
        if x.kind == "op" and x.text in _OPEN:
            stack.append(i)
        elif x.kind == "op" and x.text in _CLOSE:
            if not stack:
                raise ValueError("a bracket without a partner")
            out[i] = stack.pop()
            out[out[i]] = i
    if stack:
        raise ValueError("an open bracket")
    return out


class _Source:
    def __init__(self, source: bytes):
        self.source = source
        self.t = tokens(source)
        self.partner = _partners(self.t)
        self.imports: set[int] = set()
        self.conditions: set[int] = set()
        self.posts: set[int] = set()
        self.loops: list[tuple[int, int]] = []
        self._mark()

    def _mark(self) -> None:
        t = self.t
        for i, x in enumerate(t):
            if x.kind != "keyword":
                continue
            if x.text == b"import":
                j = i + 1
                stop = self.partner[j] if j < len(t) and t[j].text == b"(" else next((k for k in range(j, min(j + 3, len(t))) if t[k].kind == "string"), j)
                self.imports.update(range(j, stop + 1))
            elif x.text == b"for":
                self._loop(i)

    def _loop(self, i: int) -> None:
        """Marks the condition and the post statement of the loop at ``i``."""
        t, j, cuts, ranged = self.t, i + 1, [], False
        while j < len(t):
            if t[j].text == b"{" and t[j - 1].text not in (b"struct", b"interface"):
                break  # composite literals in a loop's head stand in brackets
            if t[j].text == b";":
                cuts.append(j)
            ranged = ranged or t[j].text == b"range"
            j = self.partner[j] + 1 if t[j].kind == "op" and t[j].text in _OPEN else j + 1
        if j >= len(t):
            return
        body = j
        if not ranged:
            if len(cuts) == 2:
                self.conditions.update(range(cuts[0] + 1, cuts[1]))
                self.posts.update(range(cuts[1] + 1, body))
                self.loops.append((cuts[0] + 1, cuts[1]))
            elif not cuts:
                self.conditions.update(range(i + 1, body))
                self.loops.append((i + 1, body))

    def ends_operand(self, i: int) -> bool:
        x = self.t[i]
        return x.kind in ("number", "string", "char", "name") or x.text in (b")", b"]", b"}")

    def binary(self, i: int) -> bool:
        """Whether the operator stands between two operands; ``a *T`` in the way of declarations is none."""
        t = self.t
        if i == 0 or i + 1 >= len(t) or not self.ends_operand(i - 1):
            return False
        before, after = t[i].start > t[i - 1].end, t[i + 1].start > t[i].end
        return not (t[i].text in (b"*", b"-", b"+", b"&") and before and not after)

    def left(self, i: int, low: int) -> int:
        """First token of the left operand of the connective at ``i``; ``low`` is its precedence."""
        t, j = self.t, i - 1
        while j >= 0:
            x = t[j]
            if x.kind == "op" and x.text in _CLOSE:
                j = self.partner[j] - 1
                continue
            if x.kind == "op" and (x.text in _OPEN or x.text in (b",", b";", b"=", b":=", b":", b"<-") or (x.text == b"||" and low > 1)):
                break
            if x.kind == "keyword" and x.text not in (b"func", b"struct", b"interface", b"map", b"chan"):
                break
            if j and b"\n" in self.source[t[j - 1].end : x.start] and self.ends_operand(j - 1):
                return j
            j -= 1
        return j + 1

    def right(self, i: int, low: int) -> int:
        """Last token of the right operand of the connective at ``i``."""
        t, j = self.t, i + 1
        while j < len(t):
            x = t[j]
            if x.kind == "op" and x.text in (b"(", b"["):
                j = self.partner[j]
            elif x.kind == "op" and (x.text in _CLOSE or x.text in (b"{", b",", b";", b":", b"||") or (x.text == b"&&" and low > 1)):
                break
            if j + 1 < len(t) and b"\n" in self.source[t[j].end : t[j + 1].start] and self.ends_operand(j):
                return j
            j += 1
        return j - 1


def boolean_case(op: bytes, kept: str, dropped: str) -> str:
    """The case that tells a conjunction or disjunction from one of its operands."""
    a, b, whole = ("true", "false", "conjunction stays false") if op == b"&&" else ("false", "true", "disjunction stays true")
    return f"add a case where {kept} is {a} and {dropped} is {b}, and assert that the {whole}"


def candidates(source: bytes, families: tuple[str, ...] = DEFAULT_FAMILIES) -> Iterator[Candidate]:
    """Candidates of one file in no particular order; source that cannot be read as tokens gives none."""
    try:
        s = _Source(source)
    except ValueError:
        return
    t, want = s.t, set(families)
    shape, more = structure.candidates(s, want)
    for f in more:
        yield Candidate(f.family, f.rule, f.start, f.end, f.text, f.description, f.suggestion)
    text = lambda a, b: source[t[a].start : t[b].end]
    show = lambda b: " ".join(b.decode("utf-8", "replace").split())

    def swap(family: str, table: str, rule: str, i: int, what: str) -> Iterator[Candidate]:
        if family in want and (new := _SWAPS[table].get(t[i].text)) is not None:
            told = f"add a case where {show(text(s.left(i, 3), i - 1))} equals {show(text(i + 1, s.right(i, 3)))}" if family == "boundary" else f"add a case that tells {show(t[i].text)} from {show(new)}"
            yield Candidate(family, rule, t[i].start, t[i].end, new, f"replace {what} {show(t[i].text)} with {show(new)}", told, shape.equivalent.get(i) if family == "boundary" else None)

    for i, x in enumerate(t):
        if x.kind == "op":
            if s.binary(i):
                yield from swap("boundary", "boundary", "BOUNDARY", i, "comparison")
                if not (t[i - 1].kind == "string" or t[i + 1].kind == "string"):
                    yield from swap("arithmetic", "arithmetic", "ARITHMETIC", i, "arithmetic operator")
                if i not in s.conditions:
                    yield from swap("relational", "relational", "RELATIONAL", i, "equality")
                if x.text in (b"&&", b"||"):
                    low = 2 if x.text == b"&&" else 1
                    a, b = s.left(i, low), s.right(i, low)
                    if a < i < b + 1 and "boolean" in want:
                        left, right = text(a, i - 1), text(i + 1, b)
                        yield Candidate("boolean", "BOOL-DROP-RIGHT", t[a].start, t[b].end, b"(" + left + b")", f"delete the right operand of {show(x.text)}", boolean_case(x.text, show(left), show(right)))
                        yield Candidate("boolean", "BOOL-DROP-LEFT", t[a].start, t[b].end, b"(" + right + b")", f"delete the left operand of {show(x.text)}", boolean_case(x.text, show(right), show(left)))
                    if i not in s.conditions and i not in shape.no_swap and text(a, i - 1) != text(i + 1, b):
                        yield from swap("connective", "connective", "CONN-SWAP", i, "connective")
            if x.text == b"!" and "boolean" in want and i + 1 < len(t) and not s.ends_operand(i - 1 if i else 0):
                j = i + 1
                while j < len(t) and t[j].text in (b"!", b"*", b"&", b"-"):
                    j += 1
                j = s.partner[j] if j < len(t) and t[j].text in (b"(", b"[") else j
                while j + 1 < len(t) and t[j + 1].text in (b".", b"(", b"["):
                    j = j + 2 if t[j + 1].text == b"." else s.partner[j + 1]
                if j < len(t):
                    yield Candidate("boolean", "BOOL-DROP-NOT", x.start, t[j].end, b"(" + text(i + 1, j) + b")", "delete the negation")
            if i not in s.posts:
                yield from swap("assignment", "incdec", "ASSIGN-INCDEC", i, "step")
                yield from swap("assignment", "assign", "ASSIGN-OP", i, "assignment")
        elif x.kind == "name" and x.text in (b"true", b"false") and "boolean" in want and not shape.shadowed and not (i and t[i - 1].text == b"."):
            new = b"false" if x.text == b"true" else b"true"
            yield Candidate("boolean", "BOOL-LITERAL", x.start, x.end, new, f"replace {show(x.text)} with {show(new)}", "assert what depends on this value", shape.equivalent.get(i))
        elif x.kind == "number" and "literal" in want and i not in s.conditions and i not in s.posts and re.fullmatch(rb"0|[1-9][0-9]*", x.text):
            n = int(x.text)
            if n < _INT64:
                yield Candidate("literal", "LITERAL-INC", x.start, x.end, b"%d" % (n + 1), f"replace integer {n} with {n + 1}")
                yield Candidate("literal", "LITERAL-DEC", x.start, x.end, b"%d" % (n - 1), f"replace integer {n} with {n - 1}")
        elif x.kind == "string" and "literal" in want and i not in s.imports and len(x.text) > 2 and not (i and t[i - 1].kind in ("name",) and t[i - 1].text not in _KEYWORDS and source[t[i - 1].end : x.start].strip(b" ") == b"" and x.text[:1] == b"`"):
            yield Candidate("literal", "LITERAL-STRING-EMPTY", x.start, x.end, b'""', "replace a string with an empty one")
        elif x.kind == "keyword" and x.text in (b"case", b"default") and ("switch" in want or "channel" in want):
            yield from _clause(s, i, want)
        elif x.kind == "name" and x.text == b"make" and "channel" in want and i + 2 < len(t) and t[i + 1].text == b"(" and t[i + 2].text == b"chan":
            close, depth_comma, j = s.partner[i + 1], [], i + 2
            while j < close:
                if t[j].text == b",":
                    depth_comma.append(j)
                j = s.partner[j] + 1 if t[j].kind == "op" and t[j].text in _OPEN else j + 1
            if len(depth_comma) == 1 and depth_comma[0] + 1 < close and text(depth_comma[0] + 1, close - 1) != b"0":
                yield Candidate("channel", "CHAN-UNBUFFER", t[depth_comma[0] + 1].start, t[close - 1].end, b"0", "make the channel unbuffered")
    if "loop" in want:
        for a, b in s.loops:
            if b > a:
                yield Candidate("loop", "LOOP-COND-FALSE", t[a].start, t[b - 1].end, b"false", "force the loop condition false")


def _clause(s: _Source, i: int, want: set[str]) -> Iterator[Candidate]:
    """The clause that starts at ``i``, if its body is not empty."""
    t = s.t
    colon = i + 1
    while colon < len(t) and t[colon].text != b":":
        colon = s.partner[colon] + 1 if t[colon].kind == "op" and t[colon].text in _OPEN else colon + 1
    j = colon + 1
    while j < len(t) and not (t[j].kind == "keyword" and t[j].text in (b"case", b"default")) and t[j].text != b"}":
        j = s.partner[j] + 1 if t[j].kind == "op" and t[j].text in _OPEN else j + 1
    if colon >= len(t) or j >= len(t) or j == colon + 1:
        return
    k, clauses = j, 0
    while k < len(t) and t[k].text != b"}":
        k = s.partner[k] + 1 if t[k].kind == "op" and t[k].text in _OPEN else k + 1
    if k >= len(t):
        return
    start = s.partner[k]
    head = start - 1
    is_select = t[head].text == b"select"
    m = start + 1
    while m < k:
        clauses += t[m].kind == "keyword" and t[m].text in (b"case", b"default")
        m = s.partner[m] + 1 if t[m].kind == "op" and t[m].text in _OPEN else m + 1
    family = "channel" if is_select else "switch"
    if family not in want or (is_select and clauses < 2):
        return
    rule = "CHAN-SELECT-DROP-CASE" if is_select else "SWITCH-DROP-CASE"
    yield Candidate(family, rule, t[i].start, t[j - 1].end, b"", "delete the clause " + " ".join(s.source[t[i].start : t[colon].start].decode("utf-8", "replace").split()))


def _found(source: bytes, families: tuple[str, ...]) -> list[dict]:
    """Candidates of one file without no-ops as rows but for file and id, in order of place."""
    starts = [0, *(m.end() for m in re.finditer(rb"\n", source))]

    def place(b: int) -> tuple[int, int]:
        line = bisect.bisect_right(starts, b)
        return line, b - starts[line - 1] + 1

    show = lambda b: b.decode("utf-8", "replace")
    out = []
    for c in sorted(candidates(source, families), key=lambda c: c.start):
        original = source[c.start : c.end]
        if original == c.replacement:
            continue
        (l0, c0), (l1, c1) = place(c.start), place(c.end)
        out.append({
            "operator": c.family, "rule_id": c.rule, "start_byte": c.start, "end_byte": c.end, "start_line": l0, "start_column": c0, "end_line": l1, "end_column": c1,
            "original": show(original), "replacement": show(c.replacement), "description": c.description, "suggestion": c.suggestion, "equivalent_reason": c.equivalent,
        })
    return out


def _touched(first: int, last: int, changed: set[int]) -> bool:
    return 0 in changed or any(n in changed for n in range(first, last + 1))


def _id(file: str, start: int, family: str, rule: str, original: str, replacement: str) -> str:
    return "M-" + hashlib.sha256("\0".join((file, str(start), family, rule, original, replacement)).encode()).hexdigest()[:12]


def mutation_rows(file: str, source: bytes, families: tuple[str, ...], changed: set[int] | None = None) -> list[dict]:
    """Candidates of one file as rows, without no-ops, in order of place and id; ``changed``: lines to keep to, 0 for all."""
    out = []
    for r in _found(source, families):
        if changed is None or _touched(r["start_line"], r["end_line"], changed):
            out.append({"id": _id(file, r["start_byte"], r["operator"], r["rule_id"], r["original"], r["replacement"]), "file": file, **r})
    return sorted(out, key=lambda r: (r["start_byte"], r["id"]))


# -- sources that differ in names only ---------------------------------------------------------------------------

#: Names that a rule or guard knows by themselves; every other name counts only as equal to, or unlike, others of its file.
KNOWN_NAMES = _KEYWORDS | structure.KNOWN_NAMES | {b"true", b"false", b"make"}
_TEXTS = ("original", "replacement", "description", "suggestion", "equivalent_reason")
#: What lies before a name, cut into lexemes in the very way of ``_TOKEN``, and the name.
_UP_TO_NAME = re.compile(b"((?>%s)*+)(%s)?" % (b"|".join(x for k, x in _LEXEMES.items() if k != "name"), _LEXEMES["name"]), re.S)
_WORD = re.compile(rb"[A-Za-z0-9_]+")
_STAND_IN = 0xF0000  #: first of the private characters that stand for the characters of names


class Template:
    """The rows of a source whose names are written in private characters, one for each character of a name.

    A character stands for a character, so places, lines and what is clipped are those of every source of this shape."""

    def __init__(self, source: str, families: tuple[str, ...], lengths: list[int], wanted: tuple[str, ...]):
        rows = _found(source.encode(), families)
        at, total = {0: 0}, 0
        for i, c in enumerate(source):
            total += len(c.encode())
            at[total] = i + 1
        begins = [0, *(i + 1 for i, c in enumerate(source) if c == "\n")]
        for r in rows:
            r["start_byte"], r["end_byte"] = at[r["start_byte"]], at[r["end_byte"]]
            r["start_column"], r["end_column"] = (r[f"{k}_byte"] - begins[r[f"{k}_line"] - 1] + 1 for k in ("start", "end"))
        self.rows, self.lengths = len(rows), lengths
        self.filled = {k: [r[k] for r in rows] for k in wanted if rows and k in rows[0]}
        self.texts = {k: self.filled[k] for k in _TEXTS if k in self.filled}
        self.joined = "\0".join(x or "" for c in self.texts.values() for x in c)
        used, n, self.used = set(self.joined), _STAND_IN, []
        for i, length in enumerate(lengths):
            if not used.isdisjoint(map(chr, range(n, n + length))):
                self.used.append(i)
            n += length
        self.names: list[bytes] | None = None

    def fill(self, names: list[bytes]) -> dict[str, list]:
        """The columns with ``names`` in place of the characters that stand for theirs; made anew only where one that occurs in a text has changed."""
        if (now := [names[i] for i in self.used]) != self.names:
            table = {_STAND_IN + i: c for i, c in enumerate(b"".join(names).decode())}
            plain = iter(self.joined.translate(table).split("\0"))
            for k, c in self.texts.items():
                self.filled[k] = [y if x is not None else None for x, y in zip(c, plain, strict=False)]
            self.names = now
        return self.filled


class Templates:
    """Candidates by the shape of a source, kept from its second occurrence on: sources that differ in names only are analysed twice and then filled in.

    The shape is all of a source but its names, the lengths of these and which of them are equal. Names that rules know, and those that occur in a string, comment or number as well
    (an import's last step is compared with names), belong to it as they are."""

    MOST, LONGEST, SEEN = 1 << 20, 1 << 14, 1 << 14

    def __init__(self, families: tuple[str, ...], wanted: tuple[str, ...]):
        self.families, self.wanted = families, wanted
        self.kept: dict[tuple, Template] = {}
        self.seen: set[int] = set()
        self.bytes = 0

    def of(self, source: bytes) -> tuple[int, dict[str, list]]:
        """The number of candidates and their columns ``wanted``, but for file and id."""
        if len(source) > self.LONGEST or not source.isascii() or b"\0" in source:
            return self._direct(source)
        between, names = zip(*_UP_TO_NAME.findall(source), strict=True)
        if sum(map(len, between)) + sum(map(len, names)) != len(source):
            return self._direct(source)  # a byte that starts no token
        order = {n: i for i, n in enumerate(dict.fromkeys(names))}
        fixed = KNOWN_NAMES.union(_WORD.findall(b" ".join(between)))
        key = between, tuple(map(order.__getitem__, names)), tuple(n if n in fixed else len(n) for n in order)
        free = [n for n in order if n not in fixed]
        template = self.kept.get(key)
        if template is None:
            h = hash(key)
            if h not in self.seen:
                if len(self.seen) >= self.SEEN:
                    self.seen.clear()
                self.seen.add(h)
                return self._direct(source)
            if self.bytes + len(source) > self.MOST:
                self.kept.clear()
                self.bytes = 0
            self.bytes += len(source)
            stand, n = {}, _STAND_IN
            for name in free:
                stand[name] = "".join(map(chr, range(n, n + len(name))))
                n += len(name)
            template = self.kept[key] = Template("".join(b.decode() + (stand.get(name) or name.decode()) for b, name in zip(between, names, strict=True)), self.families, list(map(len, free)), self.wanted)
        return template.rows, template.fill(free)

    def _direct(self, source: bytes) -> tuple[int, dict[str, list]]:
        rows = _found(source, self.families)
        return len(rows), {k: [r[k] for r in rows] for k in self.wanted if rows and k in rows[0]}


#: Of this process, by families and columns.
_TEMPLATES: dict[tuple, Templates] = {}


ROW = "id string, operator string, rule_id string, file string, start_byte long, end_byte long, start_line long, start_column long, end_line long, end_column long, original string, replacement string, description string, suggestion string, equivalent_reason string"
_KEYS = ("start_byte", "operator", "rule_id", "original", "replacement")


def discover(sources: DataFrame, *, file: str = "file", source: str = "source", families: tuple[str, ...] = DEFAULT_FAMILIES, changed: DataFrame | None = None, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Candidates of all files. Families, changed lines (file, line) and the columns to make (all, if not given) go into the generator, as Catalyst cannot push filters and projections into it."""
    rows = sources.select(F.col(file).alias("file"), F.encode(F.col(source), "UTF-8").alias("source") if sources.schema[source].dataType.simpleString() == "string" else F.col(source).alias("source"))
    if changed is None:
        rows = rows.withColumn("lines", F.lit(None).cast("array<bigint>"))
    else:
        lines = changed.groupBy("file").agg(F.collect_set(F.col("line").cast("bigint")).alias("lines"))
        rows = rows.join(lines, "file")

    kinds = dict(p.split(" ") for p in ROW.split(", "))
    names = tuple(kinds) if columns is None else tuple(columns)
    needed = tuple(dict.fromkeys((*names, *(_KEYS if "id" in names else ()), *(("start_line", "end_line") if changed is not None else ()))))

    def run(batches):
        schema = pa.schema([(n, pa.int64() if kinds[n] == "long" else pa.string()) for n in names])
        templates = _TEMPLATES.setdefault((families, needed), Templates(families, needed))
        made: dict[str, list] = {n: [] for n in names}
        count = 0

        def take() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(made[n], schema.field(n).type) for n in names], schema=schema)
            for c in made.values():
                c.clear()
            return out

        for b in batches:
            for f, src, lines in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n, found = (0, {}) if src is None else templates.of(src)
                if not n:
                    continue
                found = found | {"file": [f] * n}
                order = None
                if lines is not None:
                    among = set(lines)
                    order = [i for i, span in enumerate(zip(found["start_line"], found["end_line"], strict=True)) if _touched(*span, among)]
                if "id" in names:
                    found["id"] = ids = [_id(f, *x) for x in zip(*(found[k] for k in _KEYS), strict=True)]
                    order = sorted(range(n) if order is None else order, key=lambda i: (found["start_byte"][i], ids[i]))  # noqa: B023
                for k in names:
                    made[k] += found[k] if order is None else [found[k][i] for i in order]
                count += n if order is None else len(order)
                if count >= OUT_ROWS:
                    yield take()
                    count = 0
        if count:
            yield take()

    bound_batches(rows.sparkSession)
    return spread(rows.select("file", "source", "lines")).mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in names))


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt evenly over a few partitions for each core, unless they are so already: the work on a row is dear, and files may be cut into many parts of which few hold rows."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    plan = rows._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.child()
    return rows if plan.nodeName() == "Repartition" and plan.numPartitions() >= cores else rows.repartition(SHARES * cores)


def with_diffs(mutations: DataFrame, sources: DataFrame) -> DataFrame:
    """``mutations`` with their diffs; made after any limit, as it is the dear part."""
    rows = mutations.join(sources.select(F.col("file").alias("_file"), F.col("source").cast("binary").alias("_source")), F.col("file") == F.col("_file")).drop("_file")
    keep = [c for c in rows.columns if c != "_source"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_source")

    def run(batches):
        for b in batches:
            cols = [b.column(k).to_pylist() for k in ("file", "_source", "start_byte", "end_byte", "replacement")]
            diffs = [unified_diff(f, s, i, j, r.encode()) for f, s, i, j, r in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(diffs, pa.string())], [*keep, "diff"])

    bound_batches(rows.sparkSession)
    return rows.mapInArrow(run, kinds + ", diff string")
