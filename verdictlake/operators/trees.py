"""File trees: a digest of all entries, and the differences of two trees."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frame(data: bytes) -> bytes:
    """The data after its length as a variable-length integer."""
    n, out = len(data), bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out) + data


def entry_digest(rows: DataFrame, *, path: str = "rel", kind: str = "kind", mode: str = "mode", content: str = "content") -> DataFrame:
    """``rows`` with ``entry``: SHA-256 over one entry's framed path, kind, mode and content; contents are hashed where they lie."""
    size = lambda c: F.octet_length(c).cast("string")
    parts = [F.coalesce(p, F.lit(b"")) for p in (*(F.encode(F.col(c).cast("string"), "UTF-8") for c in (path, kind, mode)), F.col(content).cast("binary"))]
    framed = F.concat(*(x for p in parts for x in (F.encode(F.concat(size(p), F.lit(":")), "UTF-8"), p)))
    return rows.withColumn("entry", F.sha2(framed, 256))


def tree_digest(rows: DataFrame, tree: str = "tree", *, path: str = "rel", **columns: str) -> DataFrame:
    """(tree, digest): one digest for each tree, over its entries' digests in order of their paths. A group holds 32 bytes for each entry."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        h = hashlib.sha256()
        for p, e in sorted(zip(group[path], group["entry"], strict=True), key=lambda x: x[0].encode()):
            h.update(frame(p.encode()) + frame(bytes.fromhex(e)))
        return pd.DataFrame({tree: [group[tree].iloc[0]], "digest": [h.hexdigest()]})

    kind = rows.schema[tree].dataType.simpleString()
    return entry_digest(rows, path=path, **columns).select(tree, path, "entry").groupBy(tree).applyInPandas(run, f"`{tree}` {kind}, digest string")


def tree_differences(host: DataFrame, copy: DataFrame, *, path: str = "rel", kind: str = "kind", mode: str = "mode", content: str = "content") -> DataFrame:
    """(path, problem): missing, extra, or with another kind, mode or content."""
    side = lambda x, p: x.select(path, F.col(kind).alias(f"{p}k"), F.col(mode).alias(f"{p}m"), F.sha2(F.coalesce(F.col(content).cast("binary"), F.lit(b"")), 256).alias(f"{p}c"), F.lit(True).alias(p))
    both = side(host, "h").join(side(copy, "s"), path, "full_outer")
    problem = (
        F.when(F.col("s").isNull(), "missing").when(F.col("h").isNull(), "extra").when(~F.col("hk").eqNullSafe(F.col("sk")), "kind")
        .when(~F.col("hm").eqNullSafe(F.col("sm")), "mode").when(F.col("hc") != F.col("sc"), "content")
    )
    return both.select(path, problem.alias("problem")).where(F.col("problem").isNotNull())
