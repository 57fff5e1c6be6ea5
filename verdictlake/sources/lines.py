"""Line-based records: histories, journals, test events, package lists, test names, environments."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.batches import bound_batches

MAX_HISTORY_LINE = 1 << 20
MAX_EVENT_LINE = 256 << 10


class BadLine(ValueError):
    """A line is no record."""


def _lines(files: DataFrame, key: str, text: str) -> DataFrame:
    return files.select(key, F.posexplode(F.split(F.regexp_replace(F.col(text), r"\n\z", ""), "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long") + 1)


def parse_history(files: DataFrame, *, key: str = "path", text: str = "text") -> DataFrame:
    """History rows in file order with ``line_no`` and ``ok``; blank lines are passed over."""
    rows = _lines(files, key, text).where(F.trim(F.regexp_replace("line", r"\s", " ")) != "")
    parsed = rows.withColumn("e", F.from_json("line", schemas.HISTORY))
    is_object = F.expr("try_variant_get(try_parse_json(line), '$', 'map<string, variant>')").isNotNull()
    return parsed.select(key, "line_no", (is_object & (F.octet_length("line") <= MAX_HISTORY_LINE)).alias("ok"), "e.*")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The entries at ``path`` by ``line_no``; no file gives no rows, a malformed line fails with its number."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "path string, line_no bigint, " + schemas.HISTORY)
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    rows = parse_history(files)
    if bad := rows.where(~F.col("ok")).orderBy("path", "line_no").limit(1).collect():
        raise BadLine(f"{bad[0]['path']}: line {bad[0]['line_no']} is no history entry")
    return rows.drop("ok")


def parse_events(files: DataFrame, *, key: str = "stream_id", text: str = "text") -> DataFrame:
    """(stream, seq, event fields, lost): one row a line; malformed, oversized and unended lines only mark their stream as incomplete."""
    whole = F.col(text)
    rows = files.select(key, (~whole.endswith("\n") & (F.trim(F.substring_index(whole, "\n", -1)) != "")).alias("_open"), F.posexplode(F.split(whole, "\n")).alias("seq", "line"), F.size(F.split(whole, "\n")).alias("_n"))
    rows = rows.where(F.trim(F.regexp_replace("line", r"\s", " ")) != "")
    tail = F.col("_open") & (F.col("seq") == F.col("_n") - 1)
    long = F.octet_length("line") > MAX_EVENT_LINE
    event = F.from_json(F.when(~long & ~tail, F.col("line")), schemas.TEST_EVENT, {"mode": "PERMISSIVE"})
    is_object = F.expr("try_variant_get(try_parse_json(line), '$', 'map<string, variant>')").isNotNull()
    rows = rows.withColumn("e", event)
    text_of = lambda c: F.coalesce(F.col(f"e.{c}"), F.lit("")).alias(c)
    return rows.select(key, F.col("seq").cast("long").alias("seq"), *map(text_of, ("Action", "Package", "Test", "Output")), F.col("e.Elapsed").alias("Elapsed"), (tail | long | ~is_object).alias("lost"))


def parse_packages(files: DataFrame, *, key: str = "path", text: str = "text") -> DataFrame:
    """(path, package): the JSON objects that follow one another in each text; anything else in it fails the task."""

    def run(batches):
        decoder = json.JSONDecoder()
        for b in batches:
            keys, rows = [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at, t = 0, t or ""
                while (at := at + len(t[at:]) - len(t[at:].lstrip())) < len(t):
                    try:
                        x, at = decoder.raw_decode(t, at)
                    except json.JSONDecodeError as e:
                        raise BadLine(f"{k}: {e.msg} at {at}") from None
                    if not isinstance(x, dict):
                        raise BadLine(f"{k}: no object at {at}")
                    keys.append(k), rows.append(json.dumps(x))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(rows, pa.string())], ["path", "json"])

    bound_batches(files.sparkSession)
    rows = files.select(F.col(key).alias("path"), F.col(text).alias("text")).mapInArrow(run, "path string, json string")
    return rows.select("path", F.from_json("json", schemas.PACKAGE).alias("p")).select("path", "p.*")


def test_units(files: DataFrame, *, key: str = "package", text: str = "text") -> DataFrame:
    """(package, name, always): names a test binary lists; examples and fuzz targets always run."""
    rows = _lines(files, key, text).withColumn("name", F.trim("line"))
    always = F.col("name").startswith("Example") | F.col("name").startswith("Fuzz")
    return rows.where(always | F.col("name").startswith("Test")).select(key, "name", always.alias("always"))


def parse_environment(text: str, names: tuple[str, ...]) -> dict[str, str]:
    """Values printed one a line for ``names``; another number of lines fails, an empty last value counts."""
    lines = text.replace("\r\n", "\n").split("\n")
    if lines[-1] == "" and len(lines) == len(names) + 1:
        lines.pop()
    if len(lines) != len(names):
        raise BadLine(f"{len(lines)} lines for {len(names)} names")
    return dict(zip(names, lines, strict=True))
