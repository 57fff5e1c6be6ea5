"""Sources that differ in names only are filled in, not analysed; work is dealt over all cores."""

import inspect
import re

import pytest
from pyspark.sql import functions as F

from verdictlake.functions import discover as d
from verdictlake.functions import structure

BODY = """package p
import "a/fmt"
func NAME(a, bb int, t *T) (int, string) {
	ok := true
	ok = a < bb
	if a != bb {
		return a < bb
	}
	t.n = a // of NAME
	fmt.Do(NAME)
	for i := 0; i < a; i++ { t.put(i) }
	if ok && t.done(bb, NAME, "quite a long text in a condition that is clipped") {
		h(a)
	}
	return a + bb, t.NAME
}
"""
#: Renamings of three lengths; some are names that rules know or that the source holds elsewhere.
NAMES = [*(f"f{k}" for k in range(10, 60)), "zz", "ok", "fmt", "nil", "Add", "log", "put", "done", "true", "long", "of", "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba", "abcdefghijklmnopqrstuvwxyz", "é", "é", "a", "b", "c", "_", "i"]


def sources() -> list[tuple[str, bytes]]:
    return [(f"{i}.go", BODY.replace("NAME", n).replace("// of " + n, "// of it").encode()) for i, n in enumerate(NAMES * 2)] + [("bad", b"package p\nfunc f() { @ }\n"), ("open", b"package p\nfunc f( {\n"), ("none", b""), ("nul", b"package p // \0\nvar x = true\n")]


def test_shapes_give_what_analysis_gives(monkeypatch):
    fields = tuple(p.split(" ")[0] for p in d.ROW.split(", ") if p not in ("id string", "file string"))
    expected = [[tuple(r[k] for k in fields) for r in d.mutation_rows(f, s, d.FAMILIES)] for f, s in sources()]
    calls, real = [], d.candidates
    monkeypatch.setattr(d, "candidates", lambda *a: calls.append(1) or real(*a))
    templates = d.Templates(d.FAMILIES, fields)
    for (f, s), rows in zip(sources(), expected, strict=True):
        n, found = templates.of(s)
        got = list(zip(*(found[k] for k in fields), strict=True)) if n else []
        assert sorted(map(repr, got)) == sorted(map(repr, rows)), f
    assert len(templates.kept) > 1 and len(calls) < len(sources()) // 2


def test_kept_shapes_are_bounded(monkeypatch):
    monkeypatch.setattr(d.Templates, "MOST", 4 * len(BODY))
    monkeypatch.setattr(d.Templates, "SEEN", 4)
    templates = d.Templates(d.FAMILIES, ("rule_id",))
    for k in range(30):
        for _ in range(2):
            templates.of(BODY.replace("NAME", "n" * (k + 1)).encode())
    assert len(templates.kept) <= 4 and len(templates.seen) <= 4 and templates.bytes <= 4 * len(BODY) + 30 * 8


def test_names_that_rules_know_are_listed():
    compared = {x.encode() for m in (d, structure) for x in re.findall(r'\bb"([A-Za-z_]\w*)"', inspect.getsource(m))}
    assert b"nil" in compared and compared <= d.KNOWN_NAMES


@pytest.mark.parametrize("changed", [False, True])
def test_rows_of_a_table(spark, changed):
    rows = [(f, s) for f, s in sources() if f != "nul"]
    lines = {f: {5, 12} if i % 3 else {0} for i, (f, _) in enumerate(rows) if i % 2}
    expected = [r for f, s in rows if not changed or f in lines for r in d.mutation_rows(f, s, d.FAMILIES, lines[f] if changed else None)]
    told = spark.createDataFrame([(f, n) for f, at in lines.items() for n in at], "file string, line long") if changed else None
    table = spark.createDataFrame(rows, "file string, source binary")
    got = [r.asDict() for r in d.discover(table, families=d.FAMILIES, changed=told).collect()]
    key = lambda r: (r["file"], r["start_byte"], r["id"])
    assert sorted(got, key=key) == sorted(expected, key=key)
    some = d.discover(table, families=d.FAMILIES, changed=told, columns=("rule_id", "file"))
    assert some.columns == ["rule_id", "file"] and sorted(map(tuple, some.collect())) == sorted((r["rule_id"], r["file"]) for r in expected)


def test_many_parts_of_which_one_holds_rows_are_dealt_anew(spark):
    one = spark.range(0, 400, 1, 16).where("id < 25").select(F.col("id"))
    assert one.rdd.getNumPartitions() == 16
    dealt = d.spread(one)
    assert dealt.select(F.spark_partition_id()).distinct().count() >= 4
    again = d.spread(dealt.select((F.col("id") + 1).alias("id")))
    assert again.rdd.getNumPartitions() == dealt.rdd.getNumPartitions() and again._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 1
