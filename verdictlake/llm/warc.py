"""WARC: a Python data source that writes and reads web archives.

Reading plans partitions from whole files, small ones together. Predicates on
the record type and on other header fields are pushed into the reader: it parses
a record's headers first and goes past the record if a predicate fails, by the
member length in the gzip header's ``sl`` field where there is one, so that its
payload is neither inflated nor decoded. ``payload=false`` skips all payloads.

Writing makes one gzip member for each record in files of bounded size. A task
writes under names of its own attempt; only the commit on the driver lists them
in a manifest, and only listed files are read, so a lost or repeated task and a
write that failed leave no records behind. Folders of other writers are read whole.

Defined cases: a null payload is empty; a null url leaves the field out; line
breaks in header values are percent-encoded; an empty table gives an archive
without records.
"""

from __future__ import annotations

import base64
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition,
    IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage,
)

from .common import shared_dir, stage

SCHEMA = T.StructType([
    T.StructField("record_type", T.StringType()), T.StructField("record_id", T.StringType()), T.StructField("target_uri", T.StringType()), T.StructField("date", T.StringType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("refers_to", T.StringType()), T.StructField("payload_length", T.LongType()), T.StructField("payload", T.BinaryType()),
])
FIELDS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES = 128 << 20
PARTITION_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
MIN_PAYLOAD = 1000
#: In a folder that this writer has begun to write.
MARK = "_written-by-tasks"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else fs.FileSystem.from_uri("file:///" + path.removeprefix("file:").lstrip("/"))


def _clean(value: str) -> str:
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in value or "\n" in value else value


def _digest_text(hexa: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexa)).decode()


def _digest_hex(text: str | None) -> str | None:
    if not text or not text.lower().startswith("sha1:"):
        return text
    value = text[5:]
    return base64.b32decode(value).hex() if len(value) == 32 else value.lower()


def record_bytes(row: dict, date: str) -> bytes:
    """One record: WARC headers, HTTP headers, and for other types than revisit the payload."""
    payload = row.get("payload") or b""
    kind = row["record_type"]
    length = row.get("payload_length")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % (len(payload) if length is None else length)
    block = http if kind == "revisit" else http + payload
    head = [("WARC-Type", kind), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", date)]
    if row.get("target_uri") is not None:
        head.append(("WARC-Target-URI", _clean(row["target_uri"])))
    if row.get("payload_digest"):
        head.append(("WARC-Payload-Digest", _digest_text(row["payload_digest"])))
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", row["refers_to"])]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 1) -> bytes:
    """One gzip member whose header says how long it is, packed and unpacked."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    extra = b"sl" + struct.pack("<H", 8) + struct.pack("<II", (24 + len(body) + 8) & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Files(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.date = options["path"].rstrip("/"), options.get("date", "2000-01-01T00:00:00Z")
        self.most = int(options.get("fileBytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        where, top = _open(self.path)
        where.create_dir(top, recursive=True)
        where.open_output_stream(f"{top}/{MARK}").close()  # from now on only what is committed counts
        names: list[str] = []
        out = None
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None or out.tell() >= self.most:
                        if out is not None:
                            out.close()
                        names.append(f"{uuid.uuid4().hex}.warc.gz")
                        out = where.open_output_stream(f"{top}/{names[-1]}", compression=None)
                    out.write(gzip_member(record_bytes(row, self.date)))
        finally:
            if out is not None:
                out.close()
        return Files(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        where, top = _open(self.path)
        where.create_dir(top, recursive=True)
        with where.open_output_stream(f"{top}/_manifest-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([n for m in messages if m is not None for n in m.names]).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        where, top = _open(self.path)
        for name in (n for m in messages if m is not None for n in m.names):
            where.delete_file(f"{top}/{name}")


def _holds(f: Filter, row: dict) -> bool | None:
    """The value of a pushed predicate, None for SQL's unknown."""
    if isinstance(f, Not):
        x = _holds(f.child, row)
        return None if x is None else not x
    v = row[f.attribute[0]]
    if isinstance(f, IsNull):
        return v is None
    if isinstance(f, IsNotNull):
        return v is not None
    if isinstance(f, EqualNullSafe):
        return v == f.value
    if v is None:
        return None
    if isinstance(f, EqualTo):
        return v == f.value
    if isinstance(f, In):
        return v in f.value
    tests = {GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: str.__contains__}
    return tests[type(f)](v, f.value)


def _can_push(f: Filter) -> bool:
    if isinstance(f, Not):
        return _can_push(f.child)
    known = (IsNull, IsNotNull, EqualNullSafe, EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, StringStartsWith, StringEndsWith, StringContains)
    return isinstance(f, known) and len(f.attribute) == 1 and f.attribute[0] in {*FIELDS, "payload_length"}


class _Member:
    """A gzip member or a plain file's bytes, unpacked as far as asked for."""

    def __init__(self, file, packed: bool):
        self.file, self.packed, self.data, self.rest = file, packed, bytearray(), b""
        self.inflater = zlib.decompressobj(-15) if packed else None

    def need(self, n: int) -> bool:
        """Unpack until ``n`` bytes are there."""
        while len(self.data) < n:
            if self.packed:
                if self.inflater.eof:
                    return False
                chunk = self.rest or self.file.read(1 << 14)
                if not chunk:
                    raise ValueError("a gzip member ends too early")
                out = self.inflater.decompress(chunk, max(1 << 14, n - len(self.data)))
                self.rest = self.inflater.unconsumed_tail
                self.data += out
            else:
                chunk = self.file.read(max(1 << 14, n - len(self.data)))
                if not chunk:
                    return False
                self.data += chunk
        return True


def parse_headers(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        out[k.strip().lower().decode("utf-8", "replace")] = v.strip().decode("utf-8", "replace")
    return out


class Records:
    """The records of one file that pass ``filters``; counts the payloads that it unpacked."""

    def __init__(self, file, packed: bool, filters: list[Filter], payloads: bool):
        self.file, self.packed, self.filters, self.payloads, self.unpacked, self.skipped = file, packed, filters, payloads, 0, 0

    def __iter__(self) -> Iterator[dict]:
        at = 0
        carry = b""
        while True:
            if self.packed:
                self.file.seek(at)
                start = self.file.read(12)
                if len(start) < 12:
                    return
                if start[:3] != b"\x1f\x8b\x08":
                    raise ValueError(f"no gzip member at byte {at}")
                flags, skip, length = start[3], 10, 0
                if flags & 4:
                    n = struct.unpack("<H", start[10:12])[0]
                    extra, skip = self.file.read(n), 12 + n
                    while len(extra) >= 4:
                        size = struct.unpack("<H", extra[2:4])[0]
                        if extra[:2] == b"sl" and size == 8:
                            length = struct.unpack("<I", extra[4:8])[0]
                        extra = extra[4 + size :]
                self.file.seek(at + skip)
                for bit in (8, 16):  # a file name, a comment
                    if flags & bit:
                        while self.file.read(1) not in (b"\0", b""):
                            skip += 1
                        skip += 1
                if flags & 2:
                    self.file.seek(at + skip + 2)
                    skip += 2
                member = _Member(self.file, True)
            else:
                member, length = _Member(self.file, False), 0
                member.data = bytearray(carry)
                if not member.need(1):
                    return
            row, size = self._headers(member)
            if row is not None:
                head, http, block = size
                wanted = all(_holds(f, row) is True for f in self.filters)
                if wanted:
                    if self.payloads and row["record_type"] != "revisit":
                        if not member.need(head + block):
                            raise ValueError("a record ends too early")
                        row["payload"] = bytes(member.data[head + http : head + block])
                        self.unpacked += 1
                    yield row
                else:
                    self.skipped += 1
            if self.packed:
                if length:
                    at += length
                else:  # unpack to the end, keeping nothing
                    member.data.clear()
                    while member.need(1):
                        member.data.clear()
                    at = self.file.tell() - len(member.inflater.unused_data) + 8
            else:
                total = size[0] + size[2] + 4 if row is not None else len(member.data)
                member.need(total)
                carry = bytes(member.data[total:])

    def _headers(self, member: _Member) -> tuple[dict | None, tuple[int, int, int]]:
        n = 1
        while (end := member.data.find(b"\r\n\r\n")) < 0:
            n = len(member.data) + 1
            if not member.need(n):
                return None, (0, 0, 0)
        fields = parse_headers(bytes(member.data[:end]))
        head, block = end + 4, int(fields.get("content-length", 0))
        row: dict = {k: fields.get(v) for k, v in FIELDS.items()}
        row["payload_digest"] = _digest_hex(row["payload_digest"])
        http, row["payload"] = 0, None
        row["payload_length"] = block
        if fields.get("content-type", "").startswith("application/http"):
            while (cut := member.data.find(b"\r\n\r\n", head)) < 0 and len(member.data) < head + block:
                member.need(len(member.data) + 1)
            if 0 <= cut < head + block:
                http = cut + 4 - head
                told = parse_headers(bytes(member.data[head:cut])).get("content-length")
                row["payload_length"] = int(told) if row["record_type"] == "revisit" and told else block - http
        return row, (head, http, block)


@dataclass
class Part(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payloads = options["path"].rstrip("/"), options.get("payload", "true").lower() != "false"
        self.most = int(options.get("partitionBytes", PARTITION_BYTES))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if _can_push(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        where, top = _open(self.path)
        files = {f.base_name: f for f in where.get_file_info(fs.FileSelector(top)) if f.type == fs.FileType.File}
        listed = [n for n in files if n.startswith("_manifest-")]
        names = sorted({x for n in listed for x in json.loads(where.open_input_stream(f"{top}/{n}").read())}) if listed or MARK in files else sorted(n for n in files if n.endswith((".warc", ".warc.gz")))
        parts: list[Part] = []
        room = 0
        for n in names:
            if not parts or room < files[n].size:
                parts.append(Part([]))
                room = self.most
            parts[-1].paths.append(f"{top}/{n}")
            room -= files[n].size
        return parts or [Part([])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        where, _ = _open(self.path)
        names = SCHEMA.fieldNames()
        schema = pa.schema([(n, pa.int64() if n == "payload_length" else pa.binary() if n == "payload" else pa.string()) for n in names])
        rows, held = [], 0
        for path in partition.paths:
            with where.open_input_file(path) as f:
                for row in Records(f, path.endswith(".gz"), self.filters, self.payloads):
                    rows.append(row)
                    held += 500 + len(row["payload"] or b"")
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_warc(spark: SparkSession, path: str, *, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def warc_records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """The records of ``pages``: of equal payloads of ``min_payload`` bytes or more, that with the largest id is a response and the others revisit it."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("target_uri"), F.encode(html, "UTF-8").alias("payload"))
    rows = rows.withColumns({"payload_length": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    # written first, so that the join may split the payloads of a very common digest, or need not move payloads at all
    kept = stage(
        rows.where(F.col("payload_length") >= min_payload).groupBy(F.col("payload_digest").alias("_d"), F.col("payload_length").alias("_n"))
        .agg(F.max("id").alias("_to"), F.count("*").alias("_c")).where(F.col("_c") > 1),
        "repeated-payloads",
    )
    joined = rows.join(kept, (F.col("payload_digest") == F.col("_d")) & (F.col("payload_length") == F.col("_n")), "left")
    again = F.col("_to").isNotNull() & ~F.col("id").eqNullSafe(F.col("_to"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    return joined.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), urn(F.col("id")).alias("record_id"), "target_uri", "payload_digest",
        F.when(again, urn(F.col("_to"))).alias("refers_to"), "payload_length", F.when(~again, F.col("payload")).alias("payload"),
    )


def archive(pages: DataFrame, path: str | None = None, **columns: str) -> str:
    """Write the records of ``pages``; the folder, a new one in the shared folder by default."""
    spark = pages.sparkSession
    register(spark)
    path = path or f"{shared_dir(spark)}/verdictlake/warc-{uuid.uuid4().hex}"
    warc_records(pages, **columns).write.format("warc").mode("append").save(path)
    return path


def page_of(urn: str) -> Column:
    """The page id in the record id that the column ``urn`` holds."""
    return F.expr(f"try_cast(regexp_extract({urn}, '^<urn:page:(.*)>$', 1) as bigint)")


def summary(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as read back; digests and sizes of responses are taken from their payloads."""
    rows = read_warc(spark, path).where(F.col("record_type").isin("response", "revisit"))
    whole = F.col("record_type") == "response"
    return rows.select(
        page_of("record_id").alias("page_id"), F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(whole, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", page_of("refers_to").alias("refers_to"),
    )


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
m AS (SELECT html, max(page_id) AS top FROM p WHERE n >= {MIN_PAYLOAD} GROUP BY html)
SELECT page_id, n AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN top IS NOT NULL AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top <> page_id THEN top END AS refers_to
FROM p LEFT JOIN m ON p.html = m.html"""
