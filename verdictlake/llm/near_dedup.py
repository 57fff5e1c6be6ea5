"""MinHash near-dedup with HyperMinHash registers.

1. A text's distinct word shingles are hashed; equal sets form one class, which
   its smallest id represents. Every class gets 128 registers, each the leading
   zeros and the mantissa of a least hash in 16 bits.
2. Bands of four compressed registers are the buckets. Each bucket links its
   members to its smallest id only, so pairs grow with the rows. Sets are 64-bit
   hashes of shingles; equal sets are known by size, sum and xor of their hashes.
3. Pairs pass if their sizes and the collision-corrected similarity of their
   registers allow the threshold, and count only once the full sets confirm them.
4. Where a bucket still holds more than one component, its members of different
   components are compared in blocks of bounded size: registers against registers,
   then full sets against full sets, a list of partners in one row. Pairs in one
   component need no comparison and no row holds a single pair, so no bucket has
   its pairs made, and no link between components is lost to a bucket's size.

At similarity 0.8 a pair shares no bucket with a chance of 5e-8.

Defined cases: a text that is null or without words has an empty set and is
linked with nothing; a text of fewer words than a shingle has one shingle; rows
with the same id are one document with the links of all; a null id has no
component (null) and is kept; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import WordHash, as_bytes, bound_batches, mix64, partitions, small_batches, stage, tidy
from .components import connected_components

REGISTERS = 128
ROWS = 4
BANDS = REGISTERS // ROWS
MANTISSA = 10
BLOCK = 512
PLACE = 256
#: Pairs up to this number are sent to every task (16 bytes each); more are joined by a shuffle.
MAX_SENT = 1 << 20
SLACK = 5.0

_random = np.random.default_rng(20240229)
_A = (_random.integers(1, 1 << 31, REGISTERS, np.uint32) * np.uint32(2) + np.uint32(1)).astype(np.uint32)
_B = _random.integers(0, 1 << 32, REGISTERS, np.uint32)


def shingle_hashes(text: bytes | None, size: int, hashes: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes.of(words)
    n = max(1, len(h) - size + 1)
    key = np.full(n, min(size, len(h)), np.uint64)
    for j in range(min(size, len(h))):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return np.unique(key)


def registers(shingles: np.ndarray) -> np.ndarray:
    """Leading zeros (6 bits) and mantissa (10 bits) of the least 32-bit hash for each register."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 2048):
        np.minimum(least, (low[i : i + 2048, None] * _A[None, :] + _B[None, :]).min(0), out=least)
    part, power = np.frexp(least.astype(np.float64))
    mantissa = np.where(least > 0, ((part * 2 - 1) * (1 << MANTISSA)).astype(np.int64), 0)
    return (((32 - power) << MANTISSA) | mantissa).astype(np.uint16)


def corrected_jaccard(equal: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Similarity from the number of equal registers, less those that are equal by chance; ``n``: the smaller set's size."""
    ratio = np.maximum(n, 1) / REGISTERS
    chance = 0.169919487159739 * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return np.clip((equal / REGISTERS - chance) / (1 - chance), 0, 1)


def least_estimate(threshold: float) -> float:
    """Estimates below this belong to pairs at the threshold once in some millions."""
    return threshold - SLACK * np.sqrt(threshold * (1 - threshold) / REGISTERS)


def _sketches(docs: DataFrame, size: int) -> DataFrame:
    """(id, n, c1, c2, bands): set size, two sums that name the set, registers four to a long."""

    def run(batches):
        hashes = WordHash()
        for b in small_batches(batches, "text"):
            n, c1, c2, bands = [], [], [], []
            for text in as_bytes(b.column(1)):
                s = shingle_hashes(text, size, hashes)
                n.append(len(s))
                c1.append(int(s.sum(dtype=np.uint64).astype(np.int64)))
                c2.append(int(np.bitwise_xor.reduce(mix64(s)).astype(np.int64)) if len(s) else 0)
                bands.append(registers(s).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["id", "n", "c1", "c2", "bands"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInArrow(tidy(run), f"id {kind}, n long, c1 long, c2 long, bands array<long>")


def _flat_registers(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).view(np.uint16).reshape(-1, REGISTERS)


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of longs of a column as arrays that share its memory."""
    out = []
    for part in column.chunks:
        values, ends = part.values.to_numpy(), part.offsets.to_numpy()
        out += [values[lo:hi] for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
    return out


def _plausible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and registers allow the threshold."""
    side = lambda s: sketches.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("bands").alias(f"r_{s}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    floor = least_estimate(percent / 100)

    def run(batches):
        for b in batches:
            if b.num_rows:
                equal = (_flat_registers(b.column("r_a")) == _flat_registers(b.column("r_b"))).sum(1)
                keep = corrected_jaccard(equal, np.minimum(b.column("n_a").to_numpy(), b.column("n_b").to_numpy())) >= floor
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep))

    kind = pairs.schema["a"].dataType.simpleString()
    return rows.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(tidy(run), f"a {kind}, b {kind}")


def _sets(docs: DataFrame, wanted: DataFrame, size: int, name: str) -> DataFrame:
    """(id, s), staged: the shingle sets of the documents whose ids ``wanted`` (_id, distinct) holds, each once."""
    kind = docs.schema["id"].dataType.simpleString()
    sent = wanted.count() <= MAX_SENT
    texts = docs.join(F.broadcast(wanted) if sent else wanted.hint("merge"), F.col("id") == F.col("_id"), "left_semi")

    def sets(batches):
        hashes = WordHash()
        for b in small_batches(batches, "text"):
            made = [shingle_hashes(t, size, hashes) for t in as_bytes(b.column(1))]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in made])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(made).view(np.int64)))], ["id", "s"])

    return stage(texts.select("id", "text").mapInArrow(tidy(sets), f"id {kind}, s array<long>"), name)


def _confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold.

    A set is written once. Pairs meet the sets of either side by joins whose large partitions Spark can split, and sets
    are compared row by row, so that nothing of a hub with very many partners is ever gathered.
    """
    pairs = stage(pairs, "pairs")
    made = _sets(docs, stage(pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct(), "paired"), size, "sets")
    side = lambda k, s: made.select(F.col("id").alias(k), F.col("s").alias(s))
    common = F.size(F.array_intersect("s", "t"))
    met = pairs.join(side("a", "s"), "a").join(side("b", "t"), "b").select("a", "b", common.alias("common"), (F.size("s") + F.size("t")).alias("both"))
    return stage(met.where(100 * F.col("common") >= percent * (F.col("both") - F.col("common"))).select("a", "b").distinct(), "links")


def _candidates(rows: DataFrame, percent: int) -> DataFrame:
    """Plausible partners in other components, bucket by bucket and block against block.

    ``rows``: (band, key, id, c, cs, p, pb, n, bands). Out: (x, p, pb, ys, cs), the partners of x in one place,
    with their components; x is of the smaller component. A pair counts in its first common band only.

    A bucket's largest component (``main``) never meets itself: its blocks meet those of the other members only, which
    meet each other too. One stray in a bucket of a million copies thus costs a million rows and not their square.
    """
    kind = rows.schema["id"].dataType.simpleString()
    id_type = to_arrow_type(rows.schema["id"].dataType)
    each = rows.groupBy("band", "key", "c").agg(F.count("*").alias("m"))
    room = each.groupBy("band", "key").agg(F.max(F.struct("m", "c")).alias("top"), F.sum("m").alias("size"))
    blocks = lambda m: F.ceil(m / BLOCK).cast("int")
    room = stage(room.select("band", "key", F.col("top.c").alias("main"), blocks(F.col("top.m")).alias("mains"), blocks(F.col("size") - F.col("top.m")).alias("others")), "block-counts")
    hashed = lambda n: F.pmod(F.xxhash64("id", F.lit(7)), F.col(n)).cast("int")
    met = lambda n, use: F.transform(F.sequence(F.lit(0), F.col(n) - 1), use)
    pair = lambda x, y: F.struct(F.least(x, y).alias("b0"), F.greatest(x, y).alias("b1"))
    mine = F.when(F.col("c") == F.col("main"), -1 - hashed("mains")).otherwise(hashed("others"))
    here = rows.join(room.where("others > 0"), ["band", "key"]).withColumn("mine", mine)
    with_others = met("others", lambda o: pair(F.col("mine"), o))
    at = F.when(F.col("mine") < 0, with_others).otherwise(F.concat(with_others, met("mains", lambda m: pair(F.col("mine"), -1 - m))))
    dealt = here.withColumn("at", F.explode(at)).select("band", "key", "at.b0", "at.b1", "mine", "id", "c", "cs", "p", "pb", "n", "bands")
    floor = least_estimate(percent / 100)

    def run(group: pa.Table) -> pa.Table:
        ids, c, cs, n, mine, p, pb = (group.column(k).to_numpy() for k in ("id", "c", "cs", "n", "mine", "p", "pb"))
        r = _flat_registers(group.column("bands").combine_chunks())
        keys = r.view(np.int64)
        band, b0, b1 = (group.column(k)[0].as_py() for k in ("band", "b0", "b1"))
        left, right = np.flatnonzero(mine == b0), np.flatnonzero(mine == b1)
        pairs = []
        for i in left:
            j = right[(c[right] != c[i]) & (100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i]))]
            j = j[ids[j] > ids[i]] if b0 == b1 else j
            j = j[~(keys[j, :band] == keys[i, :band]).any(1)]
            if len(j):
                j = j[corrected_jaccard((r[j] == r[i]).sum(1), np.minimum(n[j], n[i])) >= floor]
                own = (cs[i] < cs[j]) | ((cs[i] == cs[j]) & (c[i] < c[j]))
                pairs.append(np.stack([np.where(own, i, j), np.where(own, j, i)], 1))
        at = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
        at = at[np.lexsort((at[:, 1], pb[at[:, 1]], p[at[:, 1]], at[:, 0]))]
        x, y = at[:, 0], at[:, 1]
        new = np.ones(len(at), bool)
        new[1:] = (x[1:] != x[:-1]) | (p[y[1:]] != p[y[:-1]]) | (pb[y[1:]] != pb[y[:-1]])
        cut = np.append(np.flatnonzero(new), len(at)).astype(np.int32)
        lists = lambda v: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(v, id_type))
        first = cut[:-1]
        return pa.table({"x": pa.array(ids[x[first]], id_type), "p": pa.array(p[y[first]], id_type), "pb": pa.array(pb[y[first]], pa.int32()), "ys": lists(ids[y]), "cs": lists(c[y])})

    # comparing takes long for the bytes it reads, by which Spark would put all blocks into few tasks
    dealt = dealt.repartition(partitions(rows.sparkSession), "band", "key", "b0", "b1")
    return dealt.groupBy("band", "key", "b0", "b1").applyInArrow(run, f"x {kind}, p {kind}, pb int, ys array<{kind}>, cs array<{kind}>")


def _links_across(shared: DataFrame, labelled: DataFrame, reps: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) between components that share a bucket, one at least wherever there are any.

    Documents have a place by the least hub they met, in blocks of bounded size, so that a group of near copies fills
    few blocks; a row's candidates in a block meet that block's sets, never one pair a row.
    """
    kind = docs.schema["id"].dataType.simpleString()
    id_type = to_arrow_type(docs.schema["id"].dataType)
    mixed = stage(labelled.groupBy("band", "key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where(F.col("c0") != F.col("c1")).select("band", "key"), "mixed")
    rest = stage(labelled.join(mixed, ["band", "key"]), "rest")
    if rest.isEmpty():
        return rest.select(F.col("id").alias("a"), F.col("id").alias("b"))
    place = stage(rest.select("id", "c").distinct().join(shared.groupBy("id").agg(F.min("hub").alias("p")), "id"), "place")
    sizes = stage(place.groupBy("c").agg(F.count("*").alias("cs")), "component-sizes")
    room = stage(place.groupBy("p").agg(F.ceil(F.count("*") / PLACE).cast("int").alias("blocks")), "rooms")
    place = stage(place.join(sizes, "c").join(room, "p").select("id", "c", "cs", "p", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int").alias("pb")), "places")
    found = stage(_candidates(rest.select("band", "key", "id").join(place, "id").join(reps, "id"), percent), "candidates")
    parts = stage(found.groupBy("p", "pb").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("xn")), "parts")
    asked = found.join(parts, ["p", "pb"]).withColumn("xs", F.pmod(F.xxhash64("x", F.lit(5)), F.col("xn")).cast("int")).drop("xn")
    held = place.select("id", "p", "pb").join(parts, ["p", "pb"]).withColumn("xs", F.explode(F.sequence(F.lit(0), F.col("xn") - 1))).drop("xn")
    needed = stage(held.select("id").unionByName(found.select(F.col("x").alias("id"))).distinct().withColumnRenamed("id", "_id"), "needed")
    made = _sets(docs, needed, size, "sets-across")
    asked = asked.join(made.select(F.col("id").alias("x"), "s"), "x").select(F.col("p").alias("qp"), F.col("pb").alias("qpb"), F.col("xs").alias("qxs"), F.col("x").alias("qx"), F.col("s").alias("qs"), F.col("ys").alias("qys"), F.col("cs").alias("qcs"))
    held = held.join(made, "id")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        own: dict = {}
        for y, s in zip(left.column("id").to_pylist(), _lists(left.column("s")), strict=True):
            own.setdefault(y, []).append(s)
        a, b = [], []
        xs, ys_of, cs_of = (right.column(k).to_pylist() for k in ("qx", "qys", "qcs"))
        for x, s, ys, cs in zip(xs, _lists(right.column("qs")), ys_of, cs_of, strict=True):
            done = set()
            for y, c in zip(ys, cs, strict=True):
                if c in done:
                    continue
                for t in own.get(y, ()):
                    both = np.concatenate([s, t])
                    both.sort(kind="stable")
                    common = int((both[1:] == both[:-1]).sum())
                    if 100 * common >= percent * (len(both) - common):
                        a.append(x), b.append(y), done.add(c)
                        break
        return pa.table({"a": pa.array(a, id_type), "b": pa.array(b, id_type)})

    held = held.select(*(F.col(k).alias(k) for k in ("p", "pb", "xs", "id", "s")))
    return stage(held.groupBy("p", "pb", "xs").cogroup(asked.groupBy("qp", "qpb", "qxs")).applyInArrow(compare, f"a {kind}, b {kind}").distinct(), "links-across")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row: texts whose shingle sets are similar by ``percent`` or more are linked."""
    if percent < 80:
        raise ValueError("the bands are laid out for similarities of 80 percent or more")
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = stage(_sketches(texts, shingle), "sketches")
    named = rows.where(F.col("id").isNotNull() & (F.col("n") > 0))
    classes = stage(named.groupBy("n", "c1", "c2").agg(F.min("id").alias("rep"), F.first("bands").alias("bands")), "classes")
    reps = classes.select(F.col("rep").alias("id"), "n", "bands")
    buckets = reps.select("id", F.posexplode("bands").alias("band", "key"))
    hubs = stage(buckets.groupBy("band", "key").agg(F.min("id").alias("hub"), F.count("*").alias("size")).where(F.col("size") > 1), "hubs")
    shared = stage(buckets.join(hubs, ["band", "key"]), "buckets")
    pairs = shared.where(F.col("id") != F.col("hub")).select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    links = _confirmed(_plausible(pairs, reps, percent), texts, shingle, percent)
    edge = lambda x: x.select(F.col("a").alias("u"), F.col("b").alias("v"))
    components = connected_components(edge(links))
    lab = lambda x, c: x.join(components.select(F.col("id").alias("_i"), "component"), F.col(c) == F.col("_i"), "left").withColumn("c", F.coalesce("component", c)).drop("_i", "component")
    labelled = stage(lab(shared.select("band", "key", "id", "size"), "id"), "labelled")
    more = _links_across(shared, labelled, reps, texts, shingle, percent)
    if not more.isEmpty():
        components = connected_components(edge(links.unionByName(more)))
    found = rows.drop("bands").join(classes.drop("bands"), ["n", "c1", "c2"], "left")
    first = F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("id"))
    found = lab(found.select("id", "n", F.when(F.col("id").isNotNull(), first).alias("rep")), "rep")
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("c").alias("component_id"), F.coalesce(F.col("id") == F.col("c"), F.lit(True)).alias("kept"))
