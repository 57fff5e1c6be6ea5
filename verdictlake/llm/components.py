"""Connected components of an edge table by alternating large and small stars.

Each round links every node to the least of its neighbours. Minima come from
pre-aggregated groups and go back by joins whose large partitions Spark can
split, so a node with very many neighbours is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

MAX_ROUNDS = 60
#: Rounds are many and small: a task takes so many edges where there are fewer than for all partitions.
TASK_EDGES = 200_000


def _star(pairs: DataFrame, large: bool, tasks: int) -> DataFrame:
    """Edges (u, v): neighbours of each node above it (large) or below it (small) linked to the node's least neighbour."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = stage(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("m", "u").alias("m")).coalesce(tasks), "least")
    joined = both.join(least, F.col("u") == F.col("_u"))
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    return stage(out.where(F.col("u") != F.col("v")).distinct().coalesce(tasks), "star")


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of ``edges`` (u, v) that has a smaller one in its component; the component is its least node."""
    edges = stage(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _mark(edges)
    if not before[0]:
        return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    for _ in range(MAX_ROUNDS):
        tasks = -(-before[0] // TASK_EDGES)
        edges = _star(_star(edges, True, tasks), False, tasks)
        now = _mark(edges)
        if now == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
