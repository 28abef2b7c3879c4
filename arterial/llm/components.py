"""Connected components of an edge table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernels import settle


#: Bytes of edges, 16 each, that one task joins; more are contracted by repeated joins.
ONE_TASK_BYTES = 8 << 20


def _union_find(table: pa.Table) -> pa.Table:
    parent: dict[int, int] = {}

    def root(a: int) -> int:
        while parent.setdefault(a, a) != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for u, v in zip(table.column("u").to_pylist(), table.column("v").to_pylist()):
        a, b = root(u), root(v)
        parent[max(a, b)] = min(a, b)
    ids = list(parent)
    return pa.table({"id": pa.array(ids, pa.int64()), "component": pa.array([root(i) for i in ids], pa.int64())})


def connected(edges: DataFrame, x: str, y: str) -> DataFrame:
    """``id`` and ``component`` (smallest id reachable) of every id in ``edges``.

    Up to ONE_TASK_BYTES of edges, a checked bound, one task joins them.  Beyond it two
    contractions alternate until nothing changes: each node's larger neighbours are hung on its smallest neighbour, then its smaller neighbours and
    itself are.  The number of rounds grows with the logarithm of the longest
    chain; each round is partially aggregated, and lineage is cut by a checkpoint.
    Self-loops and repeated edges are harmless; an empty table gives none.
    """
    e = settle(edges.where(F.col(x) != F.col(y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct())
    if 16 * e.count() <= ONE_TASK_BYTES:
        return settle(e.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_union_find, "id long, component long"))
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("low", "u").alias("low"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u != v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("low"))
        hung = large.join(low2, "u")
        small = hung.where("v != low").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low2.select("u", F.col("low").alias("v")))
        e = settle(small.distinct())
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if state == before:
            break
        before = state
    stars = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return settle(stars.unionByName(stars.select(F.col("component").alias("id"), "component")).distinct())
