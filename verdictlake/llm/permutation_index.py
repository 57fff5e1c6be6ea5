"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order, as far as place ``PLACES``,
and posted in the inverted files of the first ``POSTED`` of them. A query reads the
files of its own ``read`` nearest pivots (more than ``k``, so that ``k`` vectors are found where there are as many). Within a file vectors are ranked by the
footrule distance between the two (location-limited) permutations; the closest
``share`` is reranked by the exact distance, and the best of a query's files are
merged. A vector posted in several of a query's files counts in the first of them.

Pivots grow with the square root of the vectors up to ``MAX_PIVOTS``, so that a
query's part of all postings, ``POSTED * read / pivots``, falls as tables grow. Rows
shuffled are ``POSTED`` for each vector and ``read`` for each query. Files are cut into
blocks of bounded size and the queries of a file into blocks of queries, so no task
holds a whole file however common a pivot is. Equal vectors are posted once, with
their ``k + 1`` least ids, which are all that any answer can hold.

Pivots are the different vectors with the smallest hashes, taken from all of them, and
are sent to every task, 8 bytes a component; every vector is indexed.

Defined cases: vectors that are null, empty, all zero, of another length than
most, or hold null or non-finite components take no part, nor do rows with a null
id; rows that repeat id and vector count once, and an id with several vectors is
asked for and found by each of them; fewer candidates than ``k`` give fewer rows;
ties go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, hash_edge, stage, tidy

FILE_BLOCK = 16_384
QUERY_BLOCK = 2048
MAX_PIVOTS = 8192
PLACES = 32
POSTED = 8


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the vectors that take part, as floats where they are floats and else as doubles."""
    kind = "float" if vectors.schema[vec_col].dataType.elementType.simpleString() == "float" else "double"
    v = F.col(vec_col).cast(f"array<{kind}>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    zero = F.forall(v, lambda x: x == 0.0)
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(~bad).where(~zero).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.array(rows.flatten(), float).reshape(len(rows), -1) if len(rows) else np.zeros((0, 1))


def layout(n: int) -> tuple[int, int]:
    """For ``n`` different vectors: pivots, and files that a query reads."""
    pivots = min(MAX_PIVOTS, 1 << max(4, round(math.log2(4 * math.sqrt(max(n, 1))))))
    return pivots, math.ceil(pivots * min(1.0, math.sqrt(256 / pivots)) / POSTED)


def permutations(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """For each row the numbers of its nearest pivots, nearest first; of equally near ones the first."""
    out, norms = np.empty((len(x), min(length, len(pivots))), np.int16), (pivots**2).sum(1)
    for i in range(0, len(x), 256):
        d = norms[None, :] - 2 * x[i : i + 256] @ pivots.T
        out[i : i + 256] = np.argsort(d, axis=1, kind="stable")[:, : out.shape[1]]
    return out


def footrule(places: np.ndarray, perms: np.ndarray, top: int) -> np.ndarray:
    """Distances of permutations to the one that gives pivot ``p`` the place ``places[p]``, of ``top`` places each; an absent pivot counts as one place past the end."""
    a, r = places[perms], np.arange(perms.shape[1], dtype=np.int32)
    return top * (top + 1) + np.where(a < top, np.abs(r - a) - (top - a) - (top - r), 0).sum(1)


def _posted(rows: DataFrame, pivots, length: int, ids: str) -> DataFrame:
    """``rows`` with ``perm``, the numbers of their nearest pivots."""
    keep = [f.name for f in rows.schema.fields]

    def run(batches):
        for b in batches:
            perm = permutations(_matrix(b.column("v")), pivots.value, length)
            ends = np.arange(0, perm.size + 1, perm.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(perm.ravel()))], [*keep, "perm"])

    return rows.mapInArrow(tidy(run), f"{ids}, v {rows.schema['v'].dataType.simpleString()}, perm array<smallint>")


def nearest_neighbours(
    vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, n_pivots: int | None = None, read: int | None = None, share: float = 0.8
) -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` found for each row of ``queries``: query_id, rank, vec_id, score.

    ``n_pivots`` and ``read`` are ``layout``'s if they are not given; ``share`` of the postings that a query reads is reranked.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    base, asked = usable(vectors, id_col, vec_col), usable(queries, id_col, vec_col)
    size = base.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    if size is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim = size["n"]
    first_ids = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    least = base.where(F.size("v") == dim).distinct().withColumn("r", first_ids).where(F.col("r") <= k + 1)
    base = stage(least.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("ids", "v"), "vectors")
    asked = asked.where(F.size("v") == dim).distinct()
    n = base.count()
    told = layout(n)
    # a pivot is a vector of its own file, so that ``k + 2`` files hold ``k`` other vectors
    n_pivots, read = n_pivots or told[0], max(read or told[1], k + 2)
    # rows have different vectors, so the hash's edge leaves as many as are wanted
    h = F.xxhash64("v")
    sample = base.where(h <= hash_edge(n, n_pivots)).select("v").orderBy(h, "v").limit(n_pivots).collect()
    pivots = spark.sparkContext.broadcast(np.array([r["v"] for r in sample], float))
    top, files_of, read = min(PLACES, len(sample)), min(POSTED, len(sample)), min(read, len(sample))
    posted = stage(_posted(base, pivots, top, "ids array<bigint>"), "posted")
    wanted = stage(_posted(asked, pivots, max(top, read), "id bigint"), "asked")
    files = lambda rows, m: rows.select(F.explode(F.slice("perm", 1, m)).alias("pivot")).groupBy("pivot").agg(F.count("*").alias("n"))
    # blocks of some times the mean file, so that a common pivot's file is shared out before it is large
    held_at_once = min(FILE_BLOCK, max(512, 4 * n * files_of // max(1, len(sample))))
    blocks = lambda m: F.ceil(F.col(m) / {"n": held_at_once, "q": QUERY_BLOCK}[m]).cast("int")
    rooms = stage(files(posted, files_of).join(files(wanted, read).withColumnRenamed("n", "q"), "pivot").select("pivot", blocks("n").alias("held"), blocks("q").alias("met")), "files")
    deal = lambda c, m: F.pmod(F.xxhash64(c), F.col(m)).cast("int")
    all_of = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    left = posted.select(F.explode(F.slice("perm", 1, files_of)).alias("pivot"), "ids", "v", "perm").join(F.broadcast(rooms), "pivot").select("pivot", deal("v", "held").alias("x"), all_of("met").alias("y"), "ids", "v", "perm")
    right = wanted.select(F.posexplode(F.slice("perm", 1, read)).alias("place", "pivot"), "id", "v", "perm").join(F.broadcast(rooms), "pivot").select("pivot", all_of("held").alias("x"), deal("id", "met").alias("y"), "place", "id", "v", "perm")

    def search(held: pa.Table, met: pa.Table) -> pa.Table:
        q, i, s = [], [], []
        if held.num_rows and met.num_rows:
            x, ids = _matrix(held.column("v")), held.column("ids").combine_chunks()
            perm = np.array(held.column("perm").combine_chunks().flatten()).reshape(len(x), -1)
            values, ends = np.array(ids.flatten()), np.concatenate([[0], np.cumsum(np.array(ids.value_lengths()))])
            most = max(4 * k, math.ceil(share * len(x)))
            qx, qid, place, perms = _matrix(met.column("v")), met.column("id").to_numpy(), met.column("place").to_numpy(), np.array(met.column("perm").combine_chunks().flatten()).reshape(met.num_rows, -1)
            for a in range(met.num_rows):
                places = np.full(len(pivots.value), perms.shape[1], np.int32)
                places[perms[a]] = np.arange(perms.shape[1])
                near = np.flatnonzero(places[perm[:, :files_of]].min(1) == place[a])
                f = footrule(places, perm[near], top)
                if len(near) > most:
                    near = near[f <= np.partition(f, most - 1)[most - 1]]  # with all ties
                if not len(near):
                    continue
                d = np.sqrt(((x[near] - qx[a]) ** 2).sum(1))
                if len(near) > k + 1:
                    pick = np.flatnonzero(d <= np.partition(d, k)[k])
                    near, d = near[pick], d[pick]
                each = ends[near + 1] - ends[near]
                found = np.concatenate([values[ends[j] : ends[j + 1]] for j in near])
                d = np.repeat(d, each)[found != qid[a]]
                found = found[found != qid[a]]
                best = np.lexsort((found, d))[:k]
                q.append(np.full(len(best), qid[a])), i.append(found[best]), s.append(d[best])
        cat = lambda v, t: pa.array(np.concatenate(v) if v else np.zeros(0), t)
        return pa.table({"query_id": cat(q, pa.int64()), "vec_id": cat(i, pa.int64()), "score": cat(s, pa.float64())})

    found = left.groupBy("pivot", "x", "y").cogroup(right.groupBy("pivot", "x", "y")).applyInArrow(search, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
