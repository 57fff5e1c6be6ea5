"""The queries of this subpackage: each applies one operator, with production parameters, to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, crf_language, decision_list, line_dedup, near_dedup, packing, permutation_index, sanitise, url_cascade, warc
from .common import table


def op1_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op2_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = crf_language.fit(docs.where(~crf_language.held_out("doc_id")))
    return crf_language.identify(docs, model).select("doc_id", F.coalesce(crf_language.held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_cascade.judge_urls(table(spark, sf_dir, "pages"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_and_decode(table(spark, sf_dir, "documents"), digests=True)


def op5_line_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    text = F.coalesce("text", F.lit(""))
    return kept.select("doc_id", F.col("__vl_n_lines").alias("n_lines"), F.col("__vl_n_removed").alias("n_removed"), F.length(text).cast("long").alias("n_chars_kept"), F.sha2(text, 256).alias("kept_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.summary(spark, warc.archive(table(spark, sf_dir, "pages")))


def op8_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return permutation_index.nearest_neighbours(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op9_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.find_personal_data(table(spark, sf_dir, "documents"))


def op10_decision_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = decision_list.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_hyperminhash, op2_crf_language, op3_url_cascade, op4_byte_bpe, op5_line_sketches, op6_packing, op7_warc, op8_permutation_index, op9_sanitise, op10_decision_lists)}


def oracle_sql() -> dict[str, str]:
    return {"op3_url_cascade": url_cascade.oracle_sql(), "op5_line_sketches": line_dedup.oracle_sql(), "op7_warc": warc.ORACLE_SQL}
