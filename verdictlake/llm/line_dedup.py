"""Line dedup: lines that many sites share are boilerplate and are kept once.

Each line hash gets a HyperLogLog sketch of the sites that hold it; sketches
merge by aggregation, so no line's rows ever meet in one task. Lines whose
estimate lies near the threshold get an exact distinct count. A line held by at
least ``min_sites`` sites stays in the document where it comes first (smallest
id, then position) and is removed everywhere else.

Defined cases: a null text stays null and has no lines; lines of white space
only are never boilerplate; a null site counts as one site of its own; rows
repeated with the same id and text are treated alike; documents with the same
id but different texts are kept apart by a hash of the text; an empty table
gives an empty result; other columns pass through untouched, but those named ``__vl_*``
are reserved and dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, without_helpers

MIN_SITES = 6
LG_K = 8

_lines = lambda text: F.split(text, "\n")


def has_word(c: Column) -> Column:
    return c.rlike(r"[^\x20\x09-\x0D]")


def _exploded(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(id, th, site, pos, k1, k2): a row for each line with a word; 96 bits of hash name a line."""
    text = F.col(text_col)
    rows = docs.where(text.isNotNull()).select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.coalesce(F.concat(F.lit("="), F.col(site_col).cast("string")), F.lit("")).alias("site"), F.posexplode(_lines(text)).alias("pos", "line")
    )
    return rows.where(has_word(F.col("line"))).select("id", "th", "site", "pos", F.xxhash64("line").alias("k1"), F.hash("line").alias("k2"))


def boilerplate_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(k1, k2, first) of the lines on at least ``min_sites`` sites; ``first`` is where the line stays."""
    lines = _exploded(docs, id_col, text_col, site_col)
    sketched = lines.groupBy("k1", "k2").agg(
        F.hll_sketch_agg("site", lg_k).alias("sketch"), F.count("*").alias("n"), F.min(F.struct("id", "th", "pos")).alias("first")
    )
    counted = stage(sketched.where(F.col("n") >= min_sites).select("k1", "k2", "first", F.hll_sketch_estimate("sketch").alias("sites")), "line-sites")
    slack = 3 * 1.04 / 2 ** (lg_k / 2) * min_sites + 0.5
    sure = counted.where(F.col("sites") > min_sites + slack).select("k1", "k2", "first")
    near = counted.where(F.abs(F.col("sites") - min_sites) <= slack).select("k1", "k2", "first")
    exact = (
        lines.select("k1", "k2", "site").join(near.select("k1", "k2"), ["k1", "k2"], "left_semi").distinct()
        .groupBy("k1", "k2").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    )
    return sure.unionByName(near.join(exact.select("k1", "k2"), ["k1", "k2"]))


def without_positions(text: Column, removed: Column) -> Column:
    """The lines of ``text`` but for those at the sorted positions ``removed``; null if none is left."""
    edges = F.concat(F.array(F.lit(-1)), removed, F.array(F.size(_lines(text))))
    run = lambda i: F.slice(_lines(text), F.get(edges, i - 1) + 2, F.get(edges, i) - F.get(edges, i - 1) - 1)
    return F.array_join(F.flatten(F.transform(F.sequence(F.lit(1), F.size(removed) + 1), run)), "\n")


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """``docs`` with the boilerplate lines removed, and the columns ``__vl_n_lines`` (lines with a word) and ``__vl_n_removed``."""
    docs = without_helpers(docs)
    held = stage(boilerplate_lines(docs, id_col=id_col, text_col=text_col, site_col=site_col, min_sites=min_sites, lg_k=lg_k), "boilerplate")
    lines = _exploded(docs, id_col, text_col, site_col)
    first = F.struct(F.col("id"), F.col("th"), F.col("pos"))
    cut = (
        lines.join(held, ["k1", "k2"]).where(~first.eqNullSafe(F.col("first")))
        .groupBy(F.col("id").alias("__vl_cut_id"), F.col("th").alias("__vl_cut_th")).agg(F.sort_array(F.collect_set("pos")).alias("__vl_cut"))
    )
    text = F.col(text_col)
    out = docs.join(cut, F.col(id_col).eqNullSafe(F.col("__vl_cut_id")) & (F.xxhash64(text) == F.col("__vl_cut_th")), "left")
    n_lines = F.coalesce(F.size(F.filter(_lines(text), has_word)), F.lit(0))
    kept = F.when(F.col("__vl_cut").isNull(), text).otherwise(without_positions(text, F.col("__vl_cut")))
    columns = [kept.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return out.select(*columns, n_lines.cast("long").alias("__vl_n_lines"), F.coalesce(F.size("__vl_cut"), F.lit(0)).cast("long").alias("__vl_n_removed"))


def oracle_sql(min_sites: int = MIN_SITES) -> str:
    return f"""
WITH l AS (
  SELECT doc_id, text, coalesce('=' || source, '') AS site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL),
w AS (SELECT * FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
b AS (SELECT line, min(doc_id) AS first_doc FROM w GROUP BY line HAVING count(DISTINCT site) >= {min_sites}),
f AS (SELECT b.line, b.first_doc, min(w.pos) AS first_pos FROM b JOIN w ON w.line = b.line AND w.doc_id = b.first_doc GROUP BY ALL),
x AS (SELECT l.*, f.line IS NOT NULL AND NOT (l.doc_id = f.first_doc AND l.pos = f.first_pos) AS gone FROM l LEFT JOIN f ON l.line = f.line),
k AS (
  SELECT doc_id, count(*) FILTER (WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS kept
  FROM x GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CAST(length(coalesce(kept, '')) AS BIGINT) AS n_chars_kept, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id"""
