"""Every query against its SQL counterpart, by rows without regard to order."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from verdictlake import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return "~" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, sf, duck, name):
    df = catalogue.queries()[name](spark, sf)
    names = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    found = duck.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == names
    theirs = sorted(tuple(plain(r[columns.index(c)]) for c in names) for r in found.fetchall())
    assert ours == theirs
    assert ours, "an empty result proves nothing"


def test_no_huge_integers(duck):
    for name, sql in catalogue.oracle_sql().items():
        assert not [c for c in duck.execute(sql).description if "HUGE" in str(c[1])], name


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "baseline_verdict", "current_verdict", "bucket", "user_id"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no larger tables")
def test_every_bucket_occurs(spark):
    rows = {r["bucket"]: r["n"] for r in catalogue.queries()["compare_bucket_counts"](spark, "/root/testdata/sf0.01").collect()}
    assert rows == {"new_survivors": 2511, "fixed_survivors": 927, "still_open": 909, "reclassified": 446, "removed_mutants": 1714, "unchanged": 3207}
