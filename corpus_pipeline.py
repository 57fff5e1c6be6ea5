"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; what it writes is read again as the next one's documents.

Defined cases, for every stage: empty tables give empty tables; only the columns of
documents are read and all stages but the last return them, so that others may have
any name; rows are judged one by one, so that repeated rows stay repeated rows (near
copies are judged by id, and rows that share one are one document); texts are read
whole whatever their length. A null or empty text has no language and goes in the
first stage; the others keep it as it is, and packing gives it the end id alone. A
null id keeps its row. Of near copies the smallest id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictlake.llm import crf_language, line_dedup, near_dedup, packing, sanitise
from verdictlake.llm.common import stage, table

#: Columns of documents, in which all stages but the last give their rows.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` set to what is left of the text."""
    return docs.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter or without a clear language go."""
    docs = docs.select(COLUMNS)
    model = crf_language.fit(docs.where(~crf_language.held_out("doc_id")))
    return crf_language.keep_identified(docs, model)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of many sites stay once; a document that consisted of nothing else goes."""
    out = line_dedup.dedup_lines(docs.select(COLUMNS))
    empty = (F.col("__vl_n_removed") > 0) & (F.col("__vl_n_removed") >= F.col("__vl_n_lines"))
    return _counted(out.where(~empty).select(COLUMNS))


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest id."""
    docs = docs.select(COLUMNS)
    judged = near_dedup.near_duplicates(docs)
    gone = stage(judged.where(~F.col("kept")).select(F.col("doc_id").alias("__vl_gone")).distinct(), "near-copies")
    return docs.join(gone, F.col("doc_id") == F.col("__vl_gone"), "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are generalised and the terms that reveal them removed."""
    return _counted(sanitise.sanitise(docs.select(COLUMNS)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts in full sequences, with their ids."""
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_deduplication),
    ("near_dedup", near_deduplication),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: SQL has no conditional random field and no tokenizer; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
