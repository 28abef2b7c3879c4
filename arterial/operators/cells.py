"""Shortest paths on networks too large to broadcast (GR-02, 18): cells, shortcuts between their borders, and a small overlay.

Nodes are dealt into cells.  A task has one cell: it finds the costs from the nodes at
which the cell is entered to those at which it is left.  With the links between cells
these shortcuts make the overlay, whose rounds of relaxation follow the number of cells on
a path instead of its number of links.  Last, every cell is searched once more for each
origin, from the costs at which it is entered.

Costs are whole multiples of 2**-30 inside, so that sums do not depend on the way they
are taken, and ties are ties.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle

#: Parts of a unit of cost; the greatest cost is below 2**32 units.
UNIT = 1 << 30
#: Origins that one task searches a cell for.
EACH = 64


def grid_cells(nodes: DataFrame, size: float) -> DataFrame:
    """``node_id, cell`` by squares of ``size`` in the nodes' coordinates."""
    x, y = (F.floor(F.col(c) / size).cast("long") for c in ("x_coord", "y_coord"))
    return nodes.select("node_id", F.xxhash64(x, y).alias("cell"))


def _search(out: dict[int, list[tuple[int, int, int]]], offers: Iterable[tuple[int, int, int, int]]) -> dict[int, tuple[int, int, int]]:
    """node -> (cost, pred_link, pred_node) from offers (cost, node, link, pred_node), link -1 for the origin itself.  Of equal costs the smaller link, one of no cost only where no other gives the cost."""
    best: dict[int, tuple[int, int, int]] = {}
    flat: dict[int, bool] = {}
    heap: list[tuple[int, int]] = []

    def offer(cost: int, node: int, link: int, before: int, free: bool) -> None:
        old = best.get(node)
        if old is None or cost < old[0]:
            heapq.heappush(heap, (cost, node))
        elif cost > old[0] or old[1] < 0 or free or not (flat[node] or link < old[1]):
            return
        best[node], flat[node] = (cost, link, before), free

    for cost, node, link, before in offers:
        offer(cost, node, link, before, False)
    done = set()
    while heap:
        cost, node = heapq.heappop(heap)
        if node not in done:
            done.add(node)
            for to, w, link in out.get(node, ()):
                offer(cost + w, to, link, node, w == 0)
    return best


def _adjacent(links: pd.DataFrame) -> dict[int, list[tuple[int, int, int]]]:
    out: dict[int, list[tuple[int, int, int]]] = {}
    for a, b, w, link in zip(links["from_node_id"].tolist(), links["to_node_id"].tolist(), links["w"].tolist(), links["link_id"].tolist()):
        out.setdefault(a, []).append((b, w, link))
    return out


def labels(links: DataFrame, origins: DataFrame, cells: DataFrame, cost: str = "cost") -> DataFrame:
    """``origin, node, cost, pred_link, pred_node`` of every reachable node, as :func:`paths.labels` gives them.

    ``cells``: ``node_id, cell``, of a size that a task can hold; nodes without one are
    cells of their own.
    """
    kind, link_kind = origins.schema["origin"].dataType.simpleString(), links.schema["link_id"].dataType.simpleString()
    w = F.round(F.col(cost) * UNIT).cast("long")
    ends = links.select("link_id", F.col("from_node_id").cast("long").alias("from_node_id"), F.col("to_node_id").cast("long").alias("to_node_id"), w.alias("w"))
    if not ends.where("w < 0").isEmpty():
        raise ValueError("costs must not be negative")
    at = settle(cells.groupBy(F.col("node_id").cast("long").alias("node")).agg(F.min("cell").cast("long").alias("cell")))
    own = lambda node: F.coalesce("cell", F.xxhash64(node, F.lit("alone")))
    placed = ends.join(at, F.col("from_node_id") == F.col("node"), "left").withColumn("a", own("from_node_id")).drop("node", "cell")
    placed = settle(placed.join(at, F.col("to_node_id") == F.col("node"), "left").withColumn("b", own("to_node_id")).drop("node", "cell"))
    inner, between = placed.where("a = b").withColumnRenamed("a", "cell").drop("b"), placed.where("a <> b")
    start = origins.select(F.col("origin").cast("long").alias("origin")).distinct().join(at, F.col("origin") == F.col("node"), "left").withColumn("cell", own("origin")).drop("node")
    start = settle(start)
    gates = between.select(F.col("b").alias("cell"), F.col("to_node_id").alias("node"), F.lit(1).alias("way")).distinct()
    exits = between.select(F.col("a").alias("cell"), F.col("from_node_id").alias("node"), F.lit(2).alias("way")).distinct()
    seeds = start.select("cell", F.col("origin").alias("node"), F.lit(0).alias("way"))
    marks = gates.unionByName(exits).unionByName(seeds)

    def crossings(net: pd.DataFrame, marked: pd.DataFrame) -> pd.DataFrame:
        out = _adjacent(net)
        leave = set(marked.loc[marked["way"] == 2, "node"].tolist())
        rows = []
        for node, way in sorted(set(zip(marked["node"].tolist(), marked["way"].tolist()))):
            if way != 2:
                rows += [(way, node, to, c) for to, (c, _, _) in _search(out, [(0, node, -1, -1)]).items() if to in leave]
        return pd.DataFrame(rows, columns=["way", "x", "y", "w"])

    found = settle(inner.groupBy("cell").cogroup(marks.groupBy("cell")).applyInPandas(crossings, "way int, x long, y long, w long"))
    # a link between cells and the crossing behind it are one step of the overlay
    overlay = settle(between.select(F.col("from_node_id").alias("x"), F.col("to_node_id").alias("_e"), F.col("w").alias("_w")).join(found.where("way = 1").select(F.col("x").alias("_e"), "y", "w"), "_e").groupBy("x", "y").agg(F.min(F.col("_w") + F.col("w")).alias("w")))
    dist = settle(found.where("way = 0").select(F.col("x").alias("origin"), F.col("y").alias("x"), F.col("w").alias("d")))
    fresh = dist
    while not fresh.isEmpty():
        offers = fresh.join(overlay, "x").groupBy("origin", F.col("y").alias("x")).agg(F.min(F.col("d") + F.col("w")).alias("d"))
        old = dist.withColumnRenamed("d", "_old")
        fresh = settle(offers.join(old, ["origin", "x"], "left").where("_old is null or d < _old").select("origin", "x", "d"))
        dist = settle(dist.join(fresh.select("origin", "x"), ["origin", "x"], "left_anti").unionByName(fresh))
    entries = dist.join(between.select(F.col("from_node_id").alias("x"), F.col("to_node_id").alias("node"), F.col("b").alias("cell"), "link_id", "w"), "x")
    entries = entries.select("cell", "origin", "node", (F.col("d") + F.col("w")).alias("d"), F.col("link_id").cast("long").alias("link"), F.col("x").alias("before"))
    entries = entries.unionByName(start.select("cell", "origin", F.col("origin").alias("node"), F.lit(0).cast("long").alias("d"), F.lit(-1).cast("long").alias("link"), F.lit(-1).cast("long").alias("before")))
    n = max(1, -(-start.count() // EACH))
    entries = entries.withColumn("deal", F.pmod(F.xxhash64("origin"), F.lit(n)).cast("int"))
    copies = inner.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def whole(net: pd.DataFrame, offers: pd.DataFrame) -> pd.DataFrame:
        out = _adjacent(net)
        rows = []
        for origin, mine in offers.groupby("origin"):
            tree = _search(out, sorted(zip(mine["d"].tolist(), mine["node"].tolist(), mine["link"].tolist(), mine["before"].tolist())))
            rows += [(origin, node, c / UNIT, link, before) for node, (c, link, before) in tree.items()]
        return pd.DataFrame(rows, columns=["origin", "node", "cost", "link", "before"])

    tree = copies.groupBy("cell", "deal").cogroup(entries.groupBy("cell", "deal")).applyInPandas(whole, "origin long, node long, cost double, link long, before long")
    real = F.col("link") >= 0
    return tree.select(F.col("origin").cast(kind).alias("origin"), F.col("node").cast(kind).alias("node"), "cost", F.when(real, F.col("link")).cast(link_kind).alias("pred_link"), F.when(real, F.col("before")).cast(kind).alias("pred_node"))
