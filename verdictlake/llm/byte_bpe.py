"""Byte-level BPE encoding and decoding through a global distinct-word shuffle.

1. Every text is cut into pre-tokens. A block - a bounded stretch of one input
   partition - numbers its distinct words and writes each text as the sequence
   of its words' numbers: the positions.
2. The blocks' words are dealt by hash over the whole corpus, packed by block and
   bucket; a bucket encodes each of its distinct words once.
3. Ids join back to the blocks' words by another shuffle, words of ids are decoded
   by the token-byte table, and each block puts its texts together by position.

Texts themselves are never shuffled: only packed numbers are, once, and both
branches read that one exchange. A word that is in every text meets as one row
for each block, however often it occurs.

Defined cases: a null text counts as empty (no tokens, the digests of nothing);
repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import pickle
import re
import unicodedata
import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bound_batches, partitions_for, small_batches, tidy

RANKS = "byte_bpe_50k.tiktoken"
BLOCK_BYTES = 16 << 20
BLOCK_WORDS = 250_000
#: Input bytes for each bucket of words and each partition of blocks, so that tasks stay as large as they are while tables grow.
PARTITION_BYTES = 32 << 20
#: Before a text that is one word; in UTF-8 a byte that no text has.
WHOLE = "\udcff"


#: The pattern with white space spelt out: Python's ``\\s`` has control characters that the tokenizer's has not.
_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = public_tokenizers.PATTERN.replace(r"[^\s", f"[^{_SPACE}").replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoding(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})


@cache
def young() -> re.Pattern:
    """Finds characters that became letters, digits or spaces after Unicode 3.2, ceased to be, or may yet become: libraries may differ on them."""
    kind = lambda db, c: db.category(c)[0] if db.category(c)[0] in "LNZ" else "-"
    odd = [i for i in range(0x80, 0x110000) if not 0xD800 <= i < 0xE000 and (unicodedata.category(chr(i)) == "Cn" or kind(unicodedata, chr(i)) != kind(unicodedata.ucd_3_2_0, chr(i)))]
    starts = [i for i, p in zip(odd, [-2, *odd], strict=False) if i != p + 1]
    ends = [i for i, p in zip(odd, [*odd[1:], -2], strict=True) if i + 1 != p]
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(starts, ends, strict=True)) + "]")


def has_young(text: str) -> bool:
    try:
        text.encode("latin-1")
        return False
    except UnicodeEncodeError:
        return bool(young().search("".join(set(text))))


class Splitter:
    """Numbers the distinct pre-tokens of a block and writes texts as their numbers.

    Where every space of a text stands before something that is not white space, the
    pattern's matches are those in its pieces cut before each space, so the numbers
    of pieces seen before are reused.

    A text with a character that Unicode versions class differently is one word, which
    the tokenizer cuts by itself.
    """

    def __init__(self) -> None:
        self.find = regex.compile(PATTERN).findall
        self.gap = re.compile(rf" (?:[{_SPACE}]|\Z)").search
        self.numbers: dict[str, int] = {}
        self.pieces: dict[str, bytes] = {}

    def _of(self, text: str) -> bytes:
        numbers = self.numbers
        return np.array([numbers.setdefault(w, len(numbers)) for w in self.find(text)], "<u4").tobytes()

    def of(self, text: str) -> bytes:
        """Little-endian 32-bit numbers of the text's pre-tokens in order."""
        if not text.isascii() and has_young(text):
            return np.array([self.numbers.setdefault(WHOLE + text, len(self.numbers))], "<u4").tobytes()
        if self.gap(text):
            return self._of(text)
        first, *rest = text.split(" ")
        pieces = self.pieces
        for p in {*rest}.difference(pieces):
            pieces[p] = self._of(" " + p)
        return (self._of(first) if first else b"") + b"".join(map(pieces.__getitem__, rest))


def _pack_numbers(x: np.ndarray) -> list[bytes]:
    return [zstandard.compress(((x >> shift) & 255).astype(np.uint8).tobytes()) for shift in (0, 8, 16, 24)]


def _unpack_numbers(planes: list[bytes]) -> np.ndarray:
    return sum(np.frombuffer(zstandard.decompress(p), np.uint8).astype(np.uint32) << np.uint32(8 * i) for i, p in enumerate(planes))


def _pack_block(ids: list, texts: list[bytes], words: list[str]) -> bytes:
    """A block: ids, pre-tokens in each text, numbers by falling frequency, words in the order of their numbers."""
    numbers = np.frombuffer(b"".join(texts), "<u4")
    order = np.argsort(-np.bincount(numbers, minlength=len(words)), kind="stable")
    rank = np.empty(len(words), np.uint32)
    rank[order] = np.arange(len(words), dtype=np.uint32)
    raw = [words[i].encode("utf-8", "surrogateescape") for i in order]
    return pickle.dumps((ids, [len(t) // 4 for t in texts], _pack_numbers(rank[numbers]), zstandard.compress(b"".join(raw)), zstandard.compress(np.array([len(w) for w in raw], "<u4").tobytes())))


def _words_of(block: bytes) -> list[bytes]:
    _, _, _, words, lengths = pickle.loads(block)
    words, ends = zstandard.decompress(words), np.cumsum(np.frombuffer(zstandard.decompress(lengths), "<u4")).tolist()
    return [words[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


def _blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """(block, packed), a row for each block."""

    def cut(batches):
        part, block, split, ids, texts, held = TaskContext.get().partitionId(), 0, Splitter(), [], [], 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([(part << 24) + block], pa.int64()), pa.array([_pack_block(ids, texts, list(split.numbers))], pa.binary())], ["block", "packed"])

        for b in small_batches(batches, "text", 1 << 20):
            ids += b.column(0).to_pylist()
            for text in as_bytes(b.column(1)):
                texts.append(split.of((text or b"").decode()))
                held += len(text or b"")
            if held >= block_bytes or len(split.numbers) >= BLOCK_WORDS:
                yield row()
                block, split, ids, texts, held = block + 1, Splitter(), [], [], 0
        if ids:
            yield row()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(cut), "block long, packed binary")


def _pack_words(words: list[bytes]) -> bytes:
    return zstandard.compress(np.array([len(w) for w in words], "<u4").tobytes() + b"".join(words)) if words else b""


def _unpack_words(packed: bytes, n: int) -> list[bytes]:
    data = zstandard.decompress(packed)
    ends = (np.cumsum(np.frombuffer(data, "<u4", n)) + 4 * n).tolist()
    return [data[a:b] for a, b in zip([4 * n, *ends[:-1]], ends, strict=True)]


def _dealt(words: list[bytes], buckets: int) -> dict[int, list[int]]:
    """The numbers of a block's words by the bucket that encodes them."""
    of = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
    order = np.argsort(of, kind="stable")
    edges = np.searchsorted(of[order], np.arange(buckets + 1))
    return {k: order[lo:hi].tolist() for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if hi > lo}


def _encode_words(words: DataFrame, path: str) -> DataFrame:
    """(block, bucket, ids): a bucket's rows come together, and each of its distinct words is encoded once."""

    def encode(batches):
        enc, mark, now, known = encoding(path), WHOLE.encode("utf-8", "surrogateescape"), None, {}
        single = enc._core_bpe.encode_single_piece
        for b in batches:
            out = []
            for bucket, n, packed in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if bucket != now:
                    now, known = bucket, {}
                mine = _unpack_words(packed, n)
                for w in mine:
                    if w not in known:
                        known[w] = np.array(enc.encode_ordinary(w[1:].decode()) if w[:1] == mark else single(w), "<u2").tobytes()
                out.append(_pack_words([known[w] for w in mine]))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(0), pa.array(out, pa.binary())], ["block", "bucket", "ids"])

    return words.mapInArrow(tidy(encode), "block long, bucket int, ids binary")


def encode_and_decode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, digests: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each row its id, n_tokens, and ids (array<int>) and decoded (binary), or with ``digests`` ids_sha256 and decoded_sha256."""
    path = path or public_tokenizers.path(RANKS)
    bound_batches(docs.sparkSession)
    n = partitions_for(docs, PARTITION_BYTES)
    kind = docs.schema[id_col].dataType.simpleString()
    blocks = _blocks(docs, id_col, text_col, block_bytes).repartition(n, "block")

    def list_words(batches):
        for b in batches:
            for block, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = _words_of(packed)
                rows = [(k, block, len(at), _pack_words([words[i] for i in at])) for k, at in _dealt(words, n).items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["bucket", "block", "n", "words"]) if rows else empty

    empty = pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.int32(), pa.int64(), pa.int32(), pa.binary())], ["bucket", "block", "n", "words"])
    words = blocks.mapInArrow(list_words, "bucket int, block long, n int, words binary").repartition(n, "bucket").sortWithinPartitions("bucket")
    names = [id_col, "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
    types = [pa.string(), pa.string()] if digests else [pa.list_(pa.int32()), pa.binary()]

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        table = {v: k for k, v in load_ranks(path).items()}
        packed = left.column("packed")[0].as_py()
        ids, lengths, planes, _, _ = pickle.loads(packed)
        numbers, words = _unpack_numbers(planes), _words_of(packed)
        of, dealt = [b""] * len(words), _dealt(words, n)
        for k, x in zip(right.column("bucket").to_pylist(), right.column("ids").to_pylist(), strict=True):
            for i, w in zip(dealt[k], _unpack_words(x, len(dealt[k])), strict=True):
                of[i] = w
        tokens = [np.frombuffer(x, "<u2").tolist() for x in of]
        counts = np.array([len(t) for t in tokens], np.int64)
        plain = [b"".join(map(table.__getitem__, t)) for t in tokens]
        told = [b"".join(b" %d" % i for i in t) for t in tokens] if digests else None
        rows: list[list] = [[], [], []]
        at = 0
        for m in lengths:
            mine = numbers[at : at + m]
            at += m
            each = mine.tolist()
            rows[0].append(int(counts[mine].sum()))
            decoded = b"".join([plain[i] for i in each])
            if digests:
                rows[1].append(hashlib.sha256(b"".join([told[i] for i in each])[1:]).hexdigest())
                rows[2].append(hashlib.sha256(decoded).hexdigest())
            else:
                rows[1].append(np.frombuffer(b"".join([of[i] for i in each]), "<u2").astype(np.int32))
                rows[2].append(decoded)
        return pa.table([pa.array(ids, id_type), pa.array(rows[0], pa.int64()), pa.array(rows[1], types[0]), pa.array(rows[2], types[1])], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(docs.schema[id_col].dataType)
    kinds = ["string", "string"] if digests else ["array<int>", "binary"]
    schema = f"`{id_col}` {kind}, n_tokens long, {names[2]} {kinds[0]}, {names[3]} {kinds[1]}"
    return blocks.groupBy("block").cogroup(_encode_words(words, path).groupBy("block")).applyInArrow(assemble, schema)


def decode(rows: DataFrame, *, ids_col: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """``rows`` with the bytes of the ids in ``ids_col``, by the token-byte table; null ids give null, an unknown id fails."""
    path = path or public_tokenizers.path(RANKS)
    keep = [f for f in rows.schema.fields if f.name != out]

    def run(batches):
        table = {v: k for k, v in load_ranks(path).items()}
        for b in batches:
            found = [None if x is None else b"".join(map(table.__getitem__, x)) for x in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in keep), pa.array(found, pa.binary())], [*(f.name for f in keep), out])

    return rows.select(*(f.name for f in keep)).mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + f", `{out}` binary")
