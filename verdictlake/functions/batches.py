"""Arrow batches on their way to Python workers, bounded in bytes."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of one batch: rows alone, and Spark's own 64 MiB, let a worker hold several times as much as a task needs.
ARROW_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's limit on the bytes of an Arrow batch to ``ARROW_BYTES``, unless it is lower already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))
