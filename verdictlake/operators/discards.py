"""Results that every call site discards: replacing such a result cannot be seen."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import structure
from ..functions.batches import bound_batches
from ..functions.discover import _Source, spread

_LINKNAME = re.compile(rb"(?m)^[ \t]*//go:linkname[ \t]+(\S+)(?:[ \t]+(\S+))?")


def mentions_of(source: bytes) -> list[tuple[str, bool]]:
    """Every use of a name by itself, but for declarations, and whether it is a call whose results go nowhere."""
    try:
        s = _Source(source)
    except ValueError:
        return []
    shape, t = structure.Structure(s), s.t
    lone: set[int] = set()

    def walk(a: int, b: int) -> None:
        for x, y in shape.statements(a, b) if a <= b else ():
            blank = x
            while blank + 1 <= y and t[blank].text == b"_" and t[blank + 1].text == b",":
                blank += 2
            at = blank + 2 if blank + 2 <= y and t[blank].text == b"_" and t[blank + 1].text == b"=" else x
            at = at + 1 if at == x and t[x].text in (b"go", b"defer") else at
            if at + 1 <= y and t[at].kind == "name" and t[at + 1].text == b"(" and s.partner[at + 1] == y:
                lone.add(at)

    for i, x in enumerate(t):
        if x.kind == "op" and x.text == b"{" and s.partner[i] > i:
            walk(i + 1, s.partner[i] - 1)
    out = []
    for i, x in enumerate(t):
        declared = i and (t[i - 1].text == b"func" or (t[i - 1].text == b")" and t[s.partner[i - 1] - 1].text == b"func"))
        if x.kind == "name" and not declared and not (i and t[i - 1].text == b"."):
            out.append((x.text.decode("utf-8", "replace"), i in lone))
    return out


def linknames_of(source: bytes) -> list[str]:
    """The symbols that linker directives name, without their packages."""
    out: list[str] = []
    for m in _LINKNAME.finditer(source):
        out += [x.decode("utf-8", "replace").rsplit(".", 1)[-1] for x in m.groups() if x]
    return out


def mentions(sources: DataFrame, *, package: str = "package", source: str = "source") -> DataFrame:
    """(package, name, discarded, linked): a row for each mention and for each directive's symbol."""

    def run(batches):
        for b in batches:
            rows: list[tuple] = []
            for p, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                text = text or b""
                rows += [(p, n, d, False) for n, d in mentions_of(text)] + [(p, n, False, True) for n in linknames_of(text)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.string(), pa.string(), pa.bool_(), pa.bool_()), strict=True)], ["package", "name", "discarded", "linked"])

    rows = sources.select(F.col(package).cast("string").alias("package"), F.encode(F.col(source), "UTF-8").alias("source"))
    bound_batches(rows.sparkSession)
    return spread(rows).mapInArrow(run, "package string, name string, discarded boolean, linked boolean")


def discarded(functions: DataFrame, found: DataFrame) -> DataFrame:
    """``functions`` (package, name) with ``sites`` and ``always_discarded``: unexported, called at least once, every mention a call that drops its results, and named by no linker directive anywhere."""
    plain, linked = found.where(~F.col("linked")), found.where("linked").select("name").distinct()
    sites = plain.groupBy("package", "name").agg(F.count("*").alias("_sites"), F.bool_and("discarded").alias("_all"))
    joined = functions.join(sites, ["package", "name"], "left").join(linked.withColumn("_linked", F.lit(True)), "name", "left")
    unexported = F.col("name").rlike(r"^[\p{Ll}_]")
    fit = unexported & F.coalesce("_all", F.lit(False)) & F.col("_linked").isNull()
    return joined.select(*functions.columns, F.coalesce("_sites", F.lit(0)).alias("sites"), fit.alias("always_discarded"))
