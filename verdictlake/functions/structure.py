"""Statements, loops and functions of Go source, read from tokens and their matched brackets.

``Structure`` walks a file's functions statement by statement and finds what the
mutation families on conditions, returns, errors, statements, slice bounds and loop
bodies may touch. Every guard errs towards proposing less: what could end a loop,
unblock a goroutine, recurse without end or fail to compile is left alone.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

#: Calls whose removal tends to hang or end a run rather than change a result.
VITAL_CALLS = frozenset(
    "Lock Unlock RLock RUnlock TryLock TryRLock Done Wait Signal Broadcast Acquire Release Close CloseSend CloseRead CloseWrite Shutdown Cancel cancel "
    "Exit Fatal Fatalf Fatalln Panic Panicf Panicln FailNow Skip Skipf SkipNow panic close recover print println".encode().split()
)
LOG_CALLS = frozenset(b"Debug Debugf Info Infof Warn Warnf Log Logf Print Printf Println".split())
_NUMBERS = frozenset(b"int int8 int16 int32 int64 uint uint8 uint16 uint32 uint64 uintptr byte rune float32 float64".split())
_ASSIGN = frozenset((b"=", b"+=", b"-=", b"*=", b"/=", b"%=", b"&=", b"|=", b"^=", b"<<=", b">>=", b"&^="))
_COMPARE = frozenset((b"<", b"<=", b">", b">="))
_OPEN, _CLOSE = frozenset((b"(", b"[", b"{")), frozenset((b")", b"]", b"}"))
#: Names, keywords left out, that this module compares with.
KNOWN_NAMES = VITAL_CALLS | LOG_CALLS | _NUMBERS | {b"true", b"false", b"nil", b"string", b"make", b"_", b"Add", b"log", b"slog"}


@dataclass(frozen=True)
class Around:
    """What holds for a statement by where it stands."""

    results: tuple[bytes, ...] | None = None  #: zero values of the results, b"?" for kinds left alone; None for none or named in part
    function: tuple[int, int] = (0, 0)
    fixed: bool = False  #: something here may be what ends a loop, or runs on another goroutine
    headers: frozenset[bytes] = frozenset()  #: names in the heads of counted loops around
    rigid: bool = False  #: conditions and connectives are left alone: goto, self-recursion
    gotos: bool = False
    ranged: bool = False  #: inside a range loop


@dataclass
class Found:
    family: str
    rule: str
    start: int
    end: int
    text: bytes
    description: str
    suggestion: str
    equivalent: str | None = None


@dataclass
class Structure:
    s: object
    found: list[Found] = field(default_factory=list)
    equivalent: dict[int, str] = field(default_factory=dict)  #: reasons, by the number of the operator's or literal's token
    no_swap: set[int] = field(default_factory=set)  #: connectives left alone
    shadowed: bool = False  #: the file declares a ``true`` or ``false`` of its own

    def __post_init__(self) -> None:
        self.t, self.partner, self.source = self.s.t, self.s.partner, self.s.source
        self.places: dict[bytes, list[int]] = {}
        for i, x in enumerate(self.t):
            if x.kind == "name":
                self.places.setdefault(x.text, []).append(i)
        imports = [self.t[i] for i in self.s.imports]
        self.imported = {x.text.strip(b'"`').rsplit(b"/", 1)[-1] for x in imports if x.kind == "string"} | {x.text for x in imports if x.kind == "name"}
        self.constants = self._constants()
        self.shadowed = self._shadowed()
        i = 0
        while i < len(self.t):
            if self.t[i].text == b"func" and self.t[i].kind == "keyword":
                i = self._function(i, Around())
            elif self.t[i].kind == "op" and self.t[i].text in _OPEN:
                self._literals(i, self.partner[i], Around())
                i = self.partner[i] + 1
            else:
                i += 1

    # -- tokens ------------------------------------------------------------------------------------------------
    def skip(self, i: int) -> int:
        """The token after ``i``, or after the bracket pair that opens there."""
        return self.partner[i] + 1 if self.t[i].kind == "op" and self.t[i].text in _OPEN else i + 1

    def show(self, a: int, b: int, most: int = 60) -> str:
        text = " ".join(self.source[self.t[a].start : self.t[b].end].decode("utf-8", "replace").split())
        return text if len(text) <= most else text[: most - 3] + "..."

    def names(self, a: int, b: int) -> set[bytes]:
        return {x.text for x in self.t[a : b + 1] if x.kind == "name"}

    def split(self, a: int, b: int, by: bytes) -> list[tuple[int, int]]:
        """The stretches of tokens a..b between separators at their own level."""
        out, start, i = [], a, a
        while i <= b:
            if self.t[i].text == by and self.t[i].kind == "op":
                out.append((start, i - 1))
                start = i + 1
            i = self.skip(i)
        out.append((start, b))
        return out

    def unwrapped(self, a: int, b: int) -> tuple[int, int]:
        while b > a and self.t[a].text == b"(" and self.partner.get(a) == b:
            a, b = a + 1, b - 1
        return a, b

    def operators(self, a: int, b: int) -> list[int]:
        """Operators at the level of the expression a..b, selectors left out."""
        out, i = [], a
        while i <= b:
            x = self.t[i]
            if x.kind == "op" and x.text not in _OPEN and x.text not in (b".",):
                out.append(i)
            i = self.skip(i)
        return out

    def _breaks(self, i: int) -> bool:
        """Whether a statement ends between ``i`` and the next token."""
        t = self.t
        if i + 1 >= len(t) or b"\n" not in self.source[t[i].end : t[i + 1].start]:
            return False
        x = t[i]
        return x.kind in ("name", "number", "string", "char") or x.text in (b"break", b"continue", b"fallthrough", b"return", b"++", b"--", b")", b"]", b"}")

    def statements(self, a: int, b: int) -> list[tuple[int, int]]:
        out, start, i = [], a, a
        while i <= b:
            if self.t[i].text == b";" and self.t[i].kind == "op":
                if i > start:
                    out.append((start, i - 1))
                start = i = i + 1
                continue
            body = self._head(i, b) if self.t[i].kind == "keyword" and self.t[i].text in (b"if", b"for", b"switch", b"select") else None
            i = self.skip(i if body is None else body)  # semicolons in a head end no statement
            if i - 1 <= b and self._breaks(i - 1) and i - 1 >= start:
                out.append((start, i - 1))
                start = i
        if start <= b:
            out.append((start, b))
        return out

    # -- the file ----------------------------------------------------------------------------------------------
    def _constants(self) -> set[bytes]:
        out: set[bytes] = set()
        for i, x in enumerate(self.t):
            if x.kind == "keyword" and x.text == b"const" and i + 1 < len(self.t):
                if self.t[i + 1].text == b"(":
                    out |= {self.t[a].text for a, b in self.statements(i + 2, self.partner[i + 1] - 1) if a <= b}
                else:
                    out.add(self.t[i + 1].text)
        return out

    def _shadowed(self) -> bool:
        for i, x in enumerate(self.t):
            if x.kind != "name" or x.text not in (b"true", b"false") or (i and self.t[i - 1].text == b"."):
                continue
            before, after = self.t[i - 1] if i else None, self.t[i + 1] if i + 1 < len(self.t) else None
            if before is not None and before.kind == "keyword" and before.text in (b"var", b"const", b"type", b"func"):
                return True
            k = i + 1
            while k + 1 < len(self.t) and self.t[k].text == b"," and self.t[k + 1].kind == "name":
                k += 2
            if k < len(self.t) and self.t[k].text == b":=":
                return True
            if after is not None and (after.text == b":=" or (after.kind == "name" and b"\n" not in self.source[x.end : after.start])):
                return True
        return False

    def _function(self, i: int, around: Around) -> int:
        """The function that starts at ``i``, with or without a name; gives the token after it."""
        t, j, receiver, name = self.t, i + 1, False, None
        if j < len(t) and t[j].text == b"(" and self.partner[j] + 1 < len(t) and t[self.partner[j] + 1].kind == "name" and self.partner[j] + 2 < len(t) and t[self.partner[j] + 2].text in (b"(", b"["):
            after = self.partner[j] + 1
            if t[self.partner[j] + 2].text == b"(" and around.function == (0, 0):
                receiver, name, j = True, t[after].text, after + 1
        elif j < len(t) and t[j].kind == "name":
            name, j = t[j].text, j + 1
            if j < len(t) and t[j].text == b"[":
                j = self.partner[j] + 1
        if j >= len(t) or t[j].text != b"(":
            return i + 1
        j = self.partner[j] + 1
        at = j
        while j < len(t) and t[j].text != b"{" and not self._breaks(j - 1):
            j = self.skip(j) if t[j].text != b"struct" and t[j].text != b"interface" else self.skip(j + 1)
        if j >= len(t) or t[j].text != b"{":
            return max(at, i + 1)
        end, body = self.partner[j], (j + 1, self.partner[j] - 1)
        gotos = any(x.text == b"goto" for x in t[j:end])
        calls = name is not None and any(x.text == name and t[k + 1].text == b"(" and (t[k - 1].text == b".") == receiver for k, x in enumerate(t[j:end], j))
        inner = Around(results=self._zeros(at, j - 1), function=(i, end), rigid=gotos or calls, gotos=gotos)
        if around.function != (0, 0):  # a literal shares the loops and goroutines around it
            inner = replace(around, results=inner.results, rigid=around.rigid or inner.rigid, gotos=around.gotos or gotos)
        if gotos:
            self._keep_connectives(*body)
        self._block(*body, inner)
        return end + 1

    def _zeros(self, a: int, b: int) -> tuple[bytes, ...] | None:
        """Zero values of the results that tokens a..b declare."""
        t = self.t
        if a > b:
            return ()
        if t[a].text != b"(" or self.partner[a] != b:
            return (self._zero(a, b),)
        out: list[bytes] = []
        parts = self.split(a + 1, b - 1, b",")
        named = any(y > x and t[x].kind == "name" and t[x + 1].text != b"." for x, y in parts)
        waiting = 0
        for x, y in parts:
            if not named:
                out.append(self._zero(x, y))
            elif x == y:
                waiting += 1
            else:
                out += [self._zero(x + 1, y)] * (waiting + 1)
                waiting = 0
        return tuple(out) if not waiting else None

    def _zero(self, a: int, b: int) -> bytes:
        t = self.t
        if a == b and t[a].kind == "name":
            return b"0" if t[a].text in _NUMBERS else b'""' if t[a].text == b"string" else b"?"
        if (t[a].text == b"[" and self.partner[a] == a + 1) or t[a].text == b"map":
            return b"nil"
        return b"?"

    # -- statements --------------------------------------------------------------------------------------------
    def _block(self, a: int, b: int, around: Around) -> None:
        if a > b:
            return
        parts = self.statements(a, b)
        for k, (x, y) in enumerate(parts):
            self._statement(x, y, around)
            if k + 1 < len(parts):
                self._dead_store(parts[k], parts[k + 1])

    def _literals(self, a: int, b: int, around: Around) -> None:
        """Function literals, and slices, among the tokens a..b of an expression."""
        i = a
        while i <= b:
            x = self.t[i]
            if x.kind == "keyword" and x.text == b"func":
                i = max(self._function(i, around if around.function != (0, 0) else Around(function=(a, b))), i + 1)
                continue
            if x.text == b"[" and x.kind == "op":
                self._slice(i, around)
            i += 1

    def _head(self, a: int, b: int) -> int | None:
        """The brace that opens the body of the statement a..b; None where the head holds a function or a type."""
        i = a + 1
        while i <= b:
            if self.t[i].kind == "keyword" and self.t[i].text in (b"func", b"struct", b"interface"):
                return None
            if self.t[i].text == b"{":
                return i
            i = self.skip(i)
        return None

    def _statement(self, a: int, b: int, around: Around) -> None:
        t, x = self.t, self.t[a]
        if a + 1 <= b and x.kind == "name" and t[a + 1].text == b":" and t[a + 1].kind == "op":  # a label
            if a + 2 <= b:
                self._statement(a + 2, b, around)
            return
        word = x.text if x.kind == "keyword" else b""
        if word == b"if":
            self._if(a, b, around)
        elif word == b"for":
            self._for(a, b, around)
        elif word in (b"switch", b"select"):
            at = self._head(a, b)
            if at is None:
                return self._literals(a, b, around)
            self._literals(a, at - 1, around)
            self._clauses(at, around)
        elif word == b"go":
            self._literals(a, b, replace(around, fixed=True))
        elif word == b"return":
            self._return(a, b, around)
            self._literals(a, b, around)
        elif x.text == b"{" and self.partner[a] == b:
            self._block(a + 1, b - 1, around)
        else:
            if word == b"":
                self._delete(a, b, around)
            self._literals(a, b, around)

    def _clauses(self, at: int, around: Around) -> None:
        t, end, i = self.t, self.partner[at], at + 1
        while i < end:
            colon = i + 1
            while colon < end and t[colon].text != b":":
                colon = self.skip(colon)
            self._literals(i, min(colon, end - 1), around)
            j = colon + 1
            while j < end and not (t[j].kind == "keyword" and t[j].text in (b"case", b"default")):
                j = self.skip(j)
            self._block(colon + 1, min(j, end) - 1, around)
            i = j

    def _if(self, a: int, b: int, around: Around) -> None:
        t, at = self.t, self._head(a, b)
        if at is None:
            return self._literals(a, b, around)
        close = self.partner[at]
        parts = self.split(a + 1, at - 1, b";")
        cond = parts[-1]
        self._literals(a + 1, at - 1, around)
        if cond[0] > cond[1]:
            return
        touches = self._concurrent(cond[0], b)
        breaks = around.ranged and any(y.text == b"break" for y in t[a : b + 1])
        kept = around.rigid or around.fixed or breaks or bool(around.headers & self.names(a, b))
        if kept or touches:
            self._keep_connectives(*cond)
        if not kept and not touches:
            self._negate(cond)
        self._error(cond, at + 1, close - 1)
        if len(parts) == 1:
            self._guarded(cond, at + 1, close - 1)
        self._block(at + 1, close - 1, around)
        if close + 1 <= b and t[close + 1].text == b"else" and close + 2 <= b:
            self._statement(close + 2, b, around)

    def _for(self, a: int, b: int, around: Around) -> None:
        t, at = self.t, self._head(a, b)
        if at is None:
            return self._literals(a, b, around)
        body = (at + 1, self.partner[at] - 1)
        ranged = any(y.text == b"range" for y in t[a:at])
        parts = self.split(a + 1, at - 1, b";")
        cond, post = (parts[0], (1, 0)) if len(parts) == 1 else (parts[1], parts[2] if len(parts) > 2 else (1, 0))
        has_cond, has_post = not ranged and cond[0] <= cond[1], not ranged and post[0] <= post[1]
        if a + 1 == at:
            has_cond = False
        self._literals(a + 1, at - 1, around)
        if body[0] <= body[1] and (ranged or not has_cond):
            first = self.statements(*body)[0]
            self.found.append(Found("loop", "LOOP-BREAK-FIRST", t[first[0]].start, t[first[1]].end, b"break", "leave the loop before its first statement", "add a test that depends on the loop's body running"))
        if ranged:
            inner = replace(around, ranged=True)
        elif has_cond and has_post:
            inner = replace(around, headers=around.headers | self.names(a + 1, at - 1))
            self._keep_connectives(*body, inner.headers)
        else:
            inner = replace(around, fixed=True)
            self._keep_connectives(*body)
        self._block(*body, inner)

    # -- guards ------------------------------------------------------------------------------------------------
    def _keep_connectives(self, a: int, b: int, naming: frozenset[bytes] | None = None) -> None:
        for i in range(a, b + 1):
            if self.t[i].kind == "op" and self.t[i].text in (b"&&", b"||"):
                low = 2 if self.t[i].text == b"&&" else 1
                if naming is None or naming & self.names(self.s.left(i, low), self.s.right(i, low)):
                    self.no_swap.add(i)

    def _concurrent(self, a: int, b: int) -> bool:
        t = self.t
        return any(
            (x.kind == "op" and x.text == b"<-") or (x.kind == "keyword" and x.text in (b"select", b"go")) or (x.kind == "name" and x.text in VITAL_CALLS and i + 1 < len(t) and t[i + 1].text == b"(")
            for i, x in enumerate(t[a : b + 1], a)
        )

    def _orphans(self, a: int, b: int, around: Around) -> bool:
        """Whether a local name or an import that a..b uses would be used nowhere else."""
        t, (lo, hi) = self.t, around.function
        bases = {x.text for i, x in enumerate(t[a : b + 1], a) if x.kind == "name" and not (i and t[i - 1].text == b".")}
        for name in bases:
            places = self.places[name]
            if name in self.imported:
                if not any(i + 1 < len(t) and t[i + 1].text == b"." for i in places if not a <= i <= b and i not in self.s.imports):
                    return True
                continue
            local = read = False
            for i in places[bisect.bisect_left(places, lo) : bisect.bisect_right(places, hi)]:
                if a <= i <= b or t[i - 1].text == b".":
                    continue
                k = i + 1
                while k < hi and t[k].text == b"," and t[k + 1].kind == "name":
                    k += 2
                if t[k].text == b":=" or t[i - 1].text in (b"var", b"const"):
                    local = True
                elif t[k].text != b"=":
                    read = True
            if local and not read:
                return True
        return False

    def _may_move(self, a: int, b: int, around: Around) -> bool:
        return not around.fixed and not around.headers & self.names(a, b)

    # -- families ----------------------------------------------------------------------------------------------
    def _negate(self, cond: tuple[int, int]) -> None:
        a, b = self.unwrapped(*cond)
        t = self.t
        plain = a == b and t[a].text in (b"true", b"false")
        ops = [t[i].text for i in self.operators(a, b)]
        looser = b"||" in ops or b"&&" in ops
        kind = "not" if ops and t[a].text == b"!" and not [o for o in ops if o not in (b"!", b"*", b"&", b"-")] else "equality" if not looser and (b"==" in ops or b"!=" in ops) else ""
        if not plain:
            x, y = t[cond[0]].start, t[cond[1]].end
            self.found.append(Found("condition", "COND-NEGATE", x, y, b"!(" + self.source[x:y] + b")", f"negate the condition {self.show(*cond)}", "assert different outcomes where the condition holds and where it does not", kind or None))

    def _error(self, cond: tuple[int, int], a: int, b: int) -> None:
        t = self.t
        x, y = self.unwrapped(*cond)
        ops = self.operators(x, y)
        if len(ops) != 1 or t[ops[0]].text != b"!=":
            return
        sides = [self.unwrapped(x, ops[0] - 1), self.unwrapped(ops[0] + 1, y)]
        lone = [t[p].text if p == q and t[p].kind == "name" else None for p, q in sides]
        if (lone[0] == b"nil") == (lone[1] == b"nil"):
            return
        name = lone[1] if lone[0] == b"nil" else lone[0]
        if name is None or a > b:
            return
        for p, q in self.statements(a, b):
            if t[p].text == b"return" and q > p:
                last = self.split(p + 1, q, b",")[-1]
                if last[0] == last[1] and t[last[0]].text == name:
                    said = name.decode("utf-8", "replace")
                    self.found.append(Found("errorreturn", "ERR-SWALLOW", t[q].start, t[q].end, b"nil", f"return nil in place of the checked {said}", f"assert that {said} comes back and is not nil where this branch is taken"))

    def _return(self, a: int, b: int, around: Around) -> None:
        t = self.t
        if not around.results or a == b:
            return
        values = self.split(a + 1, b, b",")
        if len(values) != len(around.results):
            return
        for (x, y), zero in zip(values, around.results, strict=True):
            p, q = self.unwrapped(x, y)
            literal = p == q and (t[p].kind != "name" or t[p].text in (b"nil", b"true", b"false"))
            signed = q == p + 1 and t[p].kind == "op" and t[q].kind in ("number", "string", "char")
            empty = t[q].text == b"}" and self.partner[q] == q - 1 and b"func" not in {z.text for z in t[p:q]}
            made = t[p].text == b"make" and p + 1 <= q and t[p + 1].text == b"(" and self.partner[p + 1] == q
            if zero != b"?" and not (literal or signed or empty or made) and not self._orphans(x, y, around):
                self.found.append(Found("returnvalue", "RET-ZERO", t[x].start, t[y].end, zero, f"return the zero value {zero.decode()} in place of {self.show(x, y)}", "assert the value that is returned here"))

    def _target(self, a: int, b: int) -> bool:
        """Whether a..b names a field, an element or what a pointer points to."""
        t = self.t
        a, b = self.unwrapped(a, b)
        ops = self.operators(a, b)
        if ops and t[a].text == b"*" and len(ops) == 1:
            return True
        return not ops and b > a and (t[b - 1].text == b"." or (t[b].text == b"]" and self.partner[b] > a))

    def _delete(self, a: int, b: int, around: Around) -> None:
        t = self.t
        ops = self.operators(a, b)
        sign = next((i for i in ops if t[i].text in _ASSIGN or t[i].text == b":="), None)
        if t[b].text in (b"++", b"--") and sign is None:
            rule, fit = "STMT-DELETE-ASSIGN", self._target(a, b - 1)
        elif sign is not None:
            rule, fit = "STMT-DELETE-ASSIGN", t[sign].text != b":=" and all(self._target(x, y) for x, y in self.split(a, sign - 1, b","))
        else:
            rule, fit = "STMT-DELETE-CALL", not ops and self._spare_call(a, b)
        if fit and self._may_move(a, b, around) and not self._orphans(a, b, around):
            call = rule == "STMT-DELETE-CALL"
            self.found.append(Found("statement", rule, t[a].start, t[b].end, b"", f"delete the {'call' if call else 'assignment'} {self.show(a, b)}", "assert what this statement brings about" if call else "assert the state that this statement sets"))

    def _spare_call(self, a: int, b: int) -> bool:
        t = self.t
        if t[b].text != b")" or self.partner[b] <= a:
            return False
        open_, fun = self.partner[b], t[self.partner[b] - 1]
        if fun.kind != "name":
            return False
        if open_ - 1 == a:
            return fun.text not in VITAL_CALLS
        if t[open_ - 2].text != b"." or fun.text in VITAL_CALLS or fun.text in LOG_CALLS:
            return False
        added = fun.text == b"Add" and b == open_ + 2 and t[open_ + 1].kind == "number"
        return not added and not (open_ - 3 == a and t[a].text in (b"log", b"slog"))

    def _slice(self, i: int, around: Around) -> None:
        t, end = self.t, self.partner[i]
        if i == 0 or not self.s.ends_operand(i - 1) or (t[i - 1].text == b"}" and t[i - 1].kind == "op"):
            return
        parts = self.split(i + 1, end - 1, b":")
        if len(parts) not in (2, 3) or around.gotos:
            return
        whole = self.s.left(i, 9)
        if not self._may_move(min(whole, i), end, around):
            return
        for which, (a, b) in zip(("low", "high"), parts, strict=False):
            names = self.names(a, b)
            if a > b or not names or names & self.constants:
                continue
            p, q = self.unwrapped(a, b)
            text = self.source[t[a].start : t[b].end]
            text = text if not self.operators(p, q) else b"(" + text + b")"
            if which == "high":
                self.found.append(Found("bounds", "SLICE-HIGH", t[a].start, t[b].end, text + b" - 1", f"end the slice one before {self.show(a, b)}", "assert the slice's length and its last element"))
            else:
                self.found.append(Found("bounds", "SLICE-LOW", t[a].start, t[b].end, text + b" + 1", f"begin the slice one after {self.show(a, b)}", "assert the slice's first element"))

    # -- proofs of equivalence ---------------------------------------------------------------------------------
    def _plain(self, a: int, b: int) -> bool:
        """Names, selectors, elements, dereferences and literals only."""
        return all(x.kind in ("name", "number", "string", "char") or x.text in (b".", b"[", b"]", b"*", b"(", b")") for x in self.t[a : b + 1]) and not any(
            x.text == b"(" and i > a and self.s.ends_operand(i - 1) for i, x in enumerate(self.t[a : b + 1], a)
        )

    def _same(self, p: tuple[int, int], q: tuple[int, int]) -> bool:
        p, q = self.unwrapped(*p), self.unwrapped(*q)
        return [x.text for x in self.t[p[0] : p[1] + 1]] == [x.text for x in self.t[q[0] : q[1] + 1]]

    def _guarded(self, cond: tuple[int, int], a: int, b: int) -> None:
        """``if X != Y { return X < Y }``: the boundary of the comparison can't be seen."""
        t = self.t
        x, y = self.unwrapped(*cond)
        ops = [i for i in self.operators(x, y) if t[i].text != b"*"]
        body = self.statements(a, b) if a <= b else []
        if len(ops) != 1 or t[ops[0]].text != b"!=" or len(body) != 1 or t[body[0][0]].text != b"return":
            return
        p, q = body[0][0] + 1, body[0][1]
        if p > q:
            return
        compared = [i for i in self.operators(p, q) if t[i].text != b"*"]
        if len(compared) != 1 or t[compared[0]].text not in _COMPARE:
            return
        left, right = (x, ops[0] - 1), (ops[0] + 1, y)
        mine, other = (p, compared[0] - 1), (compared[0] + 1, q)
        if self._plain(*left) and self._plain(*right) and ((self._same(left, mine) and self._same(right, other)) or (self._same(left, other) and self._same(right, mine))):
            self.equivalent[compared[0]] = f"the condition {self.show(*cond)} around it already says that both sides differ"

    def _overwrites(self, a: int, b: int, name: bytes) -> bool:
        t = self.t
        return b > a + 1 and t[a].text == name and t[a + 1].text == b"=" and len(self.split(a + 2, b, b",")) == 1 and name not in self.names(a + 2, b)

    def _dead_store(self, one: tuple[int, int], two: tuple[int, int]) -> None:
        """``v := true`` whose next statement sets ``v`` without reading it, or does so in both of its branches."""
        t, (a, b), (c, d) = self.t, one, two
        if b != a + 2 or t[a].kind != "name" or t[a].text == b"_" or t[a + 1].text != b":=" or t[b].text not in (b"true", b"false"):
            return
        name = t[a].text
        dead = self._overwrites(c, d, name)
        if not dead and t[c].text == b"if" and (at := self._head(c, d)) is not None:
            close = self.partner[at]
            halves = [(at + 1, close - 1), (close + 3, d - 1)]
            dead = (
                len(self.split(c + 1, at - 1, b";")) == 1 and name not in self.names(c + 1, at - 1) and close + 2 <= d and t[close + 1].text == b"else" and t[close + 2].text == b"{" and self.partner[close + 2] == d
                and all(x <= y and len(self.statements(x, y)) == 1 and self._overwrites(x, y, name) for x, y in halves)
            )
        if dead:
            self.equivalent[b] = f"the next statement sets {name.decode('utf-8', 'replace')} without reading it"


def candidates(s: object, want: set[str]) -> tuple[Structure, Iterator[Found]]:
    """The structure of a file and the candidates of the families in ``want`` that rest on it, without those that another family in it proposes already."""
    found = Structure(s)
    twin = {"not": "boolean", "equality": "relational"}

    def kept() -> Iterator[Found]:
        for f in found.found:
            if f.family in want and not (f.family == "condition" and twin.get(f.equivalent or "") in want):
                yield replace(f, equivalent=None)

    return found, kept()
