"""Packing: concatenate and cut.

Pass one encodes every document, ends it with ``end_id`` and writes the ids with
each document's place inside its partition. Partition totals - one number each -
give every partition its offset by a prefix sum; pass two adds the two and cuts
the one long stream into windows of ``window`` ids. A document that crosses a
window's end gives a piece on either side. Nothing is sorted or shuffled, every
window but the last is full, and a lost executor's partition is read again from
the written ids, so that offsets never change.

Defined cases: a null text counts as empty and gives the end id alone; repeated
rows are packed once each; an empty table gives no pieces.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bound_batches, small_batches, stage, tidy

WINDOW = 2048
END_ID = 1
VOCABULARY = "word_bpe_49k.json"


class ChunkIds(dict):
    """Ids, as little-endian 16-bit bytes, of runs of text between ASCII white space.

    The vocabulary's pattern drops white space and never matches across it, so a
    text's ids are those of its runs in order. Two generations of bounded size are kept.
    """

    LIMIT = 100_000
    #: Runs of these characters only are cut here, as the vocabulary's own pattern would cut them once in lower case; all others are left to the library.
    PLAIN = re.compile("[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]+").fullmatch
    CUT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z\xdf-\xf6\xf8-\xff0-9]+").findall

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model.tokenize
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        one = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelt = str.maketrans({c: one(c)[0][0] for c in map(chr, (*range(0x21, 0x7F), *range(0xC0, 0x100)))})
        self.pieces: dict[str, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _piece(self, p: str) -> bytes:
        x = self.pieces.get(p)
        if x is None:
            x = self.pieces[p] = array("H", [t.id for t in self.model(p if p.isascii() else p.translate(self.spelt))]).tobytes()
        return x

    def __missing__(self, c: bytes) -> bytes:
        x = self.old.get(c)
        if x is None:
            if c.isalpha():
                x = self._piece(c.lower().decode())
            else:
                text = c.decode()
                if self.PLAIN(text) and not ("<|" in text and any(s in text for s in self.special)):
                    x = b"".join(map(self._piece, self.CUT(text.lower())))
                else:
                    x = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        self[c] = x
        return x

    def of(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of each text."""
        if len(self) > self.LIMIT:
            self.old = dict(self)
            self.clear()
        if len(self.pieces) > self.LIMIT:
            self.pieces.clear()
        return [b"".join(map(self.__getitem__, (t or b"").split())) for t in texts]


@cache
def chunk_ids(path: str) -> ChunkIds:
    """One for each worker process, which serves many tasks."""
    return ChunkIds(path)


def encoded(docs: DataFrame, *, id_col: str, text_col: str, path: str, end_id: int) -> DataFrame:
    """(id, part, start, ids): ids as 16-bit bytes, ``start`` counted inside the partition."""
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u2").tobytes()

    def encode(batches):
        ids_of, part, start = chunk_ids(path), TaskContext.get().partitionId(), 0
        for b in small_batches(batches, "text", 1 << 20):
            ids = [x + end for x in ids_of.of(as_bytes(b.column(1)))]
            ends = start + np.cumsum([len(x) // 2 for x in ids])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.full(len(ids), part), pa.int64()), pa.array(np.concatenate([[start], ends[:-1]]), pa.int64()), pa.array(ids, pa.binary())], ["id", "part", "start", "ids"]
            )
            start = int(ends[-1])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(encode), f"id {kind}, part long, start long, ids binary")


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """The pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ``ids`` (array<int>) if asked for."""
    spark = docs.sparkSession
    bound_batches(spark)
    kept = stage(encoded(docs, id_col=id_col, text_col=text_col, path=path or public_tokenizers.path(VOCABULARY), end_id=end_id), "packed-ids")
    totals = {r["part"]: r["n"] for r in kept.groupBy("part").agg(F.sum(F.length("ids") / 2).cast("long").alias("n")).collect()}
    bases, total = {}, 0
    for part in sorted(totals):
        bases[part], total = total, total + totals[part]
    # one long for each input partition
    shared = spark.sparkContext.broadcast(bases)
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]

    def cut(batches):
        for b in batches:
            rows: list[list] = [[] for _ in names[:7]]
            pieces = []
            for doc, part, start, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids = np.frombuffer(ids, "<u2").astype("<u4")
                at = shared.value[part] + start
                done = 0
                while done < len(ids):
                    offset = (at + done) % window
                    piece = ids[done : done + window - offset]
                    for to, v in zip(rows, (doc, done, len(piece), zlib.crc32(piece.tobytes()), len(ids), (at + done) // window, offset), strict=True):
                        to.append(v)
                    pieces.append(piece)
                    done += len(piece)
            arrays = [pa.array(r, t) for r, t in zip(rows, [b.schema.field(0).type, *[pa.int64()] * 6], strict=True)]
            if with_ids:
                edges = np.concatenate([[0], np.cumsum([len(x) for x in pieces])]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(pieces).astype(np.int32) if pieces else np.zeros(0, np.int32))))
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return kept.select("id", "part", "start", "ids").mapInArrow(tidy(cut), schema)


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, n_tokens) from pieces made ``with_ids``; the last sequence is padded to ``window`` unless its length is a power of two. A group holds one window's ids."""
    rows = pieces.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
    n = F.size("ids")
    fits = F.bit_count(n.cast("long")) == 1
    padded = F.when(fits, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad_id), window - n)))
    return rows.select("sequence_id", padded.alias("ids"), n.cast("long").alias("n_tokens"))
