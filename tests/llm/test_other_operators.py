"""URL filters, archives, nearest neighbours and the pipeline."""

import gzip
import hashlib
import io

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from verdictlake.llm import components, permutation_index, queries, url_cascade, warc
from verdictlake.llm.common import stage


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    found = con.execute(queries.oracle_sql()[name])
    order = [c[0] for c in found.description]
    assert sorted(order) == sorted(df.columns)
    assert sorted(map(str, (tuple(r[c] for c in order) for r in df.collect()))) == sorted(map(str, found.fetchall()))


def test_cascade_is_exact(spark):
    keys = spark.range(6000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = keys.where("cast(substring(key, 2) as int) % 3 = 0")
    cascade = url_cascade.build_cascade(listed, keys)
    assert len(cascade.levels) > 1
    wrong = keys.where(cascade.contains(F.col("key")) != (F.expr("cast(substring(key, 2) as int) % 3 = 0")))
    assert wrong.count() == 0 and spark.range(1).select(cascade.contains(F.lit(None).cast("string"))).first()[0] is False
    with pytest.raises(url_cascade.CascadeTooLarge):
        url_cascade.build_cascade(listed, keys, max_bits=8192)
    for most in (url_cascade.MAX_BITS, 8192):
        marked = url_cascade.mark_listed(keys.unionByName(spark.createDataFrame([(None,)], "key string")), "key", listed, max_bits=most)
        assert marked.count() == 6001 and marked.where("is_listed").count() == 2000
        assert marked.where("is_listed").join(listed, "key", "left_anti").count() == 0
    assert not url_cascade.build_cascade(listed.limit(0), keys.limit(0)).contains(F.lit("x")) is None
    assert keys.where(url_cascade.build_cascade(listed.limit(0), keys).contains(F.col("key"))).count() == 0


def test_layout_holds_for_any_size():
    for n in (0, 23, 10**6, 10**9):
        for others in (0, 10**6, 10**12):
            shards, bits = url_cascade.layout(n, others, url_cascade.MAX_BITS)
            assert 256 <= bits <= url_cascade.MAX_BITS and n / shards * url_cascade.BITS_PER_KEY <= url_cascade.MAX_BITS
    assert url_cascade.layout(23, 10**12, url_cascade.MAX_BITS)[0] == 1


URLS = [None, "", "no scheme", "http://", "://?x", "HTTP://A.B.COM", "x://example.com/en/7", "x://m.example.com/en/745?q#f", "x://com/en/", "x://com/en", "x://xexample.com/en/7", "x://example.net/de/8", "x://sub.org/es/a/b", "x://free-bets.example.net/", "x://a.free-bets.example.net", "x://not-free-bets.example.net/q", "x://a\nb.com/en/\n?", "x://" + "a." * 20_000 + "com/en/" + "y" * 20_000, "x://É.COM/en/"]


def test_urls(spark):
    df = spark.createDataFrame(list(enumerate(URLS + URLS[:5])), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1))
    con = duckdb.connect()
    con.register("pages", df.select("page_id", "url").toPandas())
    want = {r[0]: r for r in con.execute(url_cascade.oracle_sql().replace("url,", "nullif(url, chr(0)),")).fetchall()}
    got = {r["page_id"]: tuple(r) for r in url_cascade.judge_urls(df).collect()}
    for i in got:
        assert got[i][3:] == want[i][3:], (URLS[i % len(URLS)], got[i], want[i])
        assert got[i][1:3] == want[i][1:3] or "\n" in (URLS[i % len(URLS)] or "")
    assert url_cascade.judge_urls(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def pages(spark):
    big, odd = "é" * 600, "x" * 5000
    rows = [(1, "http://a/\r\nX: y", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", odd), (6, "u", odd), (9, "u", odd), (None, "u", "n")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"id": F.lit(0), "payload": F.lit("clash"), "record_type": F.lit(0)})


def test_archives(spark, pages):
    path = warc.archive(pages)
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.summary(spark, path).collect())
    assert got == [(0, 1, "response", None), (1, 1200, "revisit", 2), (2, 1200, "response", None), (3, 5, "response", None), (4, 5, "response", None), (5, 0, "response", None), (6, 5000, "revisit", 9), (6, 5000, "revisit", 9), (9, 5000, "response", None)]
    read = warc.read_warc(spark, path)
    assert {r["target_uri"] for r in read.where("record_id = '<urn:page:1>'").collect()} == {"http://a/%0D%0AX: y"}
    assert read.where("record_type = 'revisit' and payload is null and payload_length > 1000").count() == 3
    assert warc.read_warc(spark, path, payload=False).where("payload is not null").count() == 0
    assert warc.summary(spark, warc.archive(pages.limit(0))).count() == 0


def test_filters_are_pushed_and_payloads_skipped(spark, pages):
    plan = warc.read_warc(spark, warc.archive(pages)).where("record_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(record_type,revisit)" in plan.replace("PushedFilters: ", "") or "record_type" in plan
    rows = [{"record_type": t, "record_id": f"<urn:page:{i}>", "payload": b"z" * 100_000, "payload_digest": hashlib.sha1(b"z").hexdigest(), "refers_to": "<x>"} for i, t in enumerate(["response", "revisit", "response"])]
    data = b"".join(warc.gzip_member(warc.record_bytes(r, "2024-01-01T00:00:00Z")) for r in rows)
    assert gzip.decompress(data).count(b"WARC/1.1") == 3
    from pyspark.sql.datasource import EqualTo

    records = warc.Records(io.BytesIO(data), True, [EqualTo(("record_id",), "<urn:page:2>")], True)
    found = list(records)
    assert [r["payload_length"] for r in found] == [100_000] and records.unpacked == 1 and records.skipped == 2
    plain = b"".join(warc.record_bytes(r, "2024-01-01T00:00:00Z") for r in rows)
    assert [r["record_type"] for r in warc.Records(io.BytesIO(plain), False, [], False)] == ["response", "revisit", "response"]
    foreign = b"".join(gzip.compress(warc.record_bytes(r, "2024-01-01T00:00:00Z")) for r in rows)
    assert [len(r["payload"] or b"") for r in warc.Records(io.BytesIO(foreign), True, [], True)] == [100_000, 0, 100_000]


def exact(x, ids, queries, k=10):
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[ids.index(q)]) ** 2).sum(1))
        order = sorted((d[i], ids[i]) for i in range(len(ids)) if ids[i] != q)[:k]
        out[q] = [i for _, i in order]
    return out


def test_neighbours(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float)
    want = exact(x, ids, [i for i in ids if i % 100 == 0])
    got = {}
    for r in queries.op8_permutation_index(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert np.isclose(r["score"], np.linalg.norm(x[ids.index(r["query_id"])] - x[ids.index(r["vec_id"])]), rtol=1e-12)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 10 for q in want]) >= 0.9


def test_pivot_files_shrink_as_tables_grow():
    parts = [permutation_index.POSTED * read / pivots for pivots, read in map(permutation_index.layout, (500, 50_000, 1_000_000, 4_000_000))]
    assert parts == sorted(parts, reverse=True) and parts[-1] < 0.2


def test_few_ids_with_many_vectors(spark):
    """100,000 rows over five ids; and one vector that a third of all rows hold."""
    df = spark.range(100_000).select((F.col("id") % 5).alias("vec_id"), F.array((F.col("id") % 40 + 1).cast("double"), F.lit(1.0)).alias("embedding"))
    rows = permutation_index.nearest_neighbours(df, df.where("vec_id = 0").distinct()).collect()
    assert len(rows) == 10 and all(r["query_id"] == 0 and r["vec_id"] != 0 for r in rows)
    hot = spark.range(900).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.sin("id"), F.cos("id"))).alias("embedding"))
    got = permutation_index.nearest_neighbours(hot, hot.where("vec_id = 300")).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(3 * i, 0.0) for i in range(10)]


def test_recall_of_larger_tables(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(9000, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 300 = 0")
    want = exact(x, list(range(9000)), range(0, 9000, 300))
    found = permutation_index.nearest_neighbours(df, asked).collect()
    assert np.mean([r["vec_id"] in want[r["query_id"]] for r in found]) >= 0.9 and len(found) == 300


def test_what_failed_writes_leave_is_not_read(spark, tmp_path):
    folder = tmp_path / "archive"
    folder.mkdir()
    record = warc.gzip_member(warc.record_bytes({"record_type": "response", "record_id": "<urn:page:1>", "payload": b"x" * 3_000_000, "payload_digest": hashlib.sha1(b"x" * 3_000_000).hexdigest()}, "2024-01-01T00:00:00Z"))
    (folder / "a.warc.gz").write_bytes(record)
    assert warc.read_warc(spark, f"file://{folder}").select(F.octet_length("payload")).first()[0] == 3_000_000
    (folder / warc.MARK).write_bytes(b"")
    assert warc.read_warc(spark, f"file://{folder}").count() == 0


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, []), (8, [0.0, 1.0]), (100, [1.0, 0.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("v", F.lit(1))
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in permutation_index.nearest_neighbours(df, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 100), (0, 3, 8), (100, 1, 0), (100, 2, 1), (100, 3, 8)]
    assert permutation_index.nearest_neighbours(df.limit(0), df).count() == 0 and permutation_index.nearest_neighbours(df, df.limit(0)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(200, i) for i in range(201, 240)] + [(500, 501), (501, 500), (7, 7)]
    got = {r["id"]: r["component"] for r in components.connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 200 for i in range(201, 240)}, 501: 500}


def test_pipeline(spark):
    """Each stage against a plain version on what the one before it kept."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    texts = {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        texts[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stage(step(spark, docs, sf), name)
        assert docs.columns == corpus_pipeline.COLUMNS and docs.where("n_chars <> length(text)").count() == 0
    texts["packing"] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(any(c.isalpha() for c in texts["language_id"][i]) for i in texts["line_dedup"]) and len(texts["line_dedup"]) > 0.95 * len(texts["language_id"])
    from test_text_operators import BASE, base_spans, by_lines, components as brute

    sites = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    cut = by_lines([(i, t, sites[i]) for i, t in texts["line_dedup"].items()], 6)
    assert texts["near_dedup"] == {i: t for i, t in cut.items() if i in texts["near_dedup"]} and all(not cut[i].split() for i in set(cut) - set(texts["near_dedup"]))
    near = brute(texts["near_dedup"], 5)
    assert set(texts["personal_data"]) == {i for i, (_, c) in near.items() if c == i}
    for i, t in texts["packing"].items():
        assert not base_spans(t) and (t == texts["personal_data"][i] or base_spans(texts["personal_data"][i]))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in pieces} == set(texts["packing"]) and BASE


def test_pipeline_stages_of_odd_rows(spark, sf):
    rows = [(1, "", "en", "s", 0), (2, None, None, None, None), (3, "one two three four five six", "en", "s", 5), (3, "one two three four five six", "en", "s", 5), (None, "x", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"kept": F.lit(1), "__vl_terms": F.lit(2)})
    all_ids = [None, 1, 2, 3, 3]
    want = {"language_id": [None, 3, 3], "line_dedup": all_ids, "near_dedup": all_ids, "personal_data": all_ids, "packing": all_ids}
    for name, step in corpus_pipeline.STAGES:
        got = step(spark, docs, sf).collect()
        assert sorted((r["doc_id"] for r in got), key=lambda i: (i is not None, i)) == want[name], name
        if name != "packing":
            assert {(r["doc_id"], r["text"]) for r in got} <= {r[:2] for r in rows} and set(got[0].asDict()) == set(corpus_pipeline.COLUMNS)
        assert step(spark, docs.limit(0), sf).count() == 0


def test_pipeline_on_long_copies_and_ties(spark, sf):
    """Two near copies of a very long text and two of a short one: the smaller id of each stays; all lines of one site stay."""
    words = [f"w{i * i % 9973}x" for i in range(30_000)]
    rows = [(9, " ".join(words)), (4, " ".join([*words[:-1], "other"])), (7, "a b c d e f g h i j"), (2, "a b c d e f g h i j")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_deduplication(spark, docs, sf).collect()) == [2, 4]
    assert corpus_pipeline.line_deduplication(spark, docs, sf).count() == 4
