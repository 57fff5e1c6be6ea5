"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space; ``bytes.split()`` cuts at exactly these bytes.
WORD_GAP = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; a local one only where that is unset and there are no other machines."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "verdictlake-shared")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut, and a lost executor costs a re-read only."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/verdictlake/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def without_helpers(df: DataFrame) -> DataFrame:
    """``df`` without columns whose names begin with ``__vl_``, which are reserved for what operators add."""
    return df.drop(*(c for c in df.columns if c.startswith("__vl_")))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: An input of unknown size is estimated at exabytes, and so may be a product of sizes.
MOST_BYTES = 1 << 50
#: Bytes of one Arrow batch on its way to a Python worker: rows alone do not bound it where texts are long.
ARROW_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's limit on the bytes of an Arrow batch to ``ARROW_BYTES``, unless it is lower already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def give_back() -> None:
    """Return freed memory to the system; a Python worker otherwise holds it through the stages that follow."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, for mapInArrow, whose memory goes back to the system when a task ends."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(df: DataFrame, each: int) -> int:
    """Shuffle partitions of some ``each`` bytes of ``df``'s input by Spark's own estimate where it has one, and no fewer than the session has."""
    told = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(partitions(df.sparkSession), -(-told // each) if told < MOST_BYTES else 0)


class WordHash(dict):
    """64-bit hashes of words, kept while there are few enough of them."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded text, so that no batch of long documents fills a worker's memory."""
    for b in batches:
        if not b.num_rows:
            continue
        step = max(1, int(b.num_rows * most / max(1, b.column(column).nbytes)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def hash_edge(rows: int, most: int) -> int:
    """The hash below which some three times ``most`` of ``rows`` rows lie: cutting there first keeps what tasks send for the ``most`` least hashes bounded in total."""
    return min((1 << 63) - 1, int(-(1 << 63) + 3 * (most + 20) / max(1, rows) * (1 << 64)))
