"""Shortest paths and routes (GR-01, 02, 07, 18, 19, 21, FLT-09, SET-03).

The relational form relaxes all origins at once until nothing improves; among equal costs the smaller predecessor link
is taken.  Origins are independent, so the grouped form runs Dijkstra per origin inside
tasks with the network, whose size is checked, broadcast as arrays; both give the same
labels.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import units
from ..session import settle

#: Bytes of a network, 28 for each link, up to which it is broadcast to tasks.
NETWORK_BYTES = 128 << 20


def adjacency(links: DataFrame, agent_types: DataFrame) -> DataFrame:
    """GR-01: the links that each agent type may use: ``agent_type`` and the columns of ``links``."""
    return links.crossJoin(F.broadcast(agent_types)).where(units.allowed(F.col("allowed_uses"), F.col("agent_type")))


def with_connectors(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """GR-21: add links both ways between every zone node and its centroid, numbered -zone_id.

    Connectors have a cost of 0.0001 minutes and no capacity limit; FLT-09 is kept by
    construction, since a centroid's connectors leave from that centroid only.
    """
    n = nodes.where("zone_id is not null")
    out = n.select((-F.col("zone_id")).alias("from_node_id"), F.col("node_id").alias("to_node_id"), (-2 * F.col("zone_id")).alias("link_id"))
    back = n.select(F.col("node_id").alias("from_node_id"), (-F.col("zone_id")).alias("to_node_id"), (-2 * F.col("zone_id") - 1).alias("link_id"))
    more = out.unionByName(back).withColumns({"cost": F.lit(0.0001), "link_type": F.lit(-1), "lane_capacity": F.lit(99999.0)})
    return links.unionByName(more, allowMissingColumns=True)


def labels(links: DataFrame, origins: DataFrame, cost: str = "cost") -> DataFrame:
    """GR-02: ``origin, node, cost, pred_link, pred_node`` of every reachable node.

    ``links`` has ``link_id, from_node_id, to_node_id`` and the cost column (not
    negative).  Each round joins the labels that changed with the links; lineage is
    cut every round, since the next one reads the labels three times.  A link of no cost is
    taken only where no other gives the cost, so that equal costs make no cycle.  Rounds go on
    until no label changes; a best path enters a node once, so labels that still change
    after as many rounds as there are nodes to enter mean negative costs, an error.
    """
    edges = settle(links.select("link_id", "from_node_id", "to_node_id", F.col(cost).alias("w")))
    best = origins.select(F.col("origin"), F.col("origin").alias("node"), F.lit(0.0).alias("cost"), F.lit(None).cast("int").alias("pred_link"), F.lit(None).cast("int").alias("pred_node"), F.lit(0).alias("flat"))
    best = settle(best.distinct())
    changed = best
    for _ in range(edges.select("to_node_id").distinct().count() + 1):
        step = changed.join(edges, changed["node"] == edges["from_node_id"])
        offers = step.groupBy("origin", F.col("to_node_id").alias("node")).agg(F.min(F.struct((F.col("cost") + F.col("w")).alias("cost"), (F.col("w") == 0).cast("int").alias("flat"), F.col("link_id").alias("pred_link"), F.col("from_node_id").alias("pred_node"))).alias("offer"))
        old = best.select("origin", "node", F.col("cost").alias("old"), F.col("pred_link").alias("old_link"), F.col("flat").alias("old_flat"))
        tie = (F.col("offer.cost") == F.col("old")) & (F.col("offer.flat") == 0) & F.col("old_link").isNotNull()
        cheaper = (F.col("offer.cost") < F.col("old")) | (tie & ((F.col("old_flat") == 1) | (F.col("offer.pred_link") < F.col("old_link"))))
        better = offers.join(old, ["origin", "node"], "left").where(F.col("old").isNull() | cheaper)
        changed = settle(better.select("origin", "node", "offer.cost", "offer.pred_link", "offer.pred_node", "offer.flat"))
        if changed.isEmpty():
            return best.drop("flat")
        kept = best.join(changed.select("origin", "node"), ["origin", "node"], "left_anti")
        best = settle(kept.unionByName(changed))
    raise ValueError("labels do not settle: the costs have a negative cycle")


class Network:
    """Links by node they leave, as arrays: what a task needs to search from one origin."""

    def __init__(self, rows: np.ndarray):
        """``rows``: link, from, to, cost."""
        rows = rows[np.lexsort((rows[:, 0], rows[:, 1]))]
        self.nodes = np.unique(rows[:, 1:3].astype(np.int64))
        self.link = rows[:, 0].astype(np.int64)
        self.to = np.searchsorted(self.nodes, rows[:, 2].astype(np.int64)).astype(np.int32)
        self.cost = rows[:, 3]
        self.first = np.searchsorted(rows[:, 1].astype(np.int64), self.nodes, side="left")
        self.last = np.searchsorted(rows[:, 1].astype(np.int64), self.nodes, side="right")

    def search(self, origin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(node, cost, pred_link, pred_node) of every node that can be reached; -1 for the origin's predecessor."""
        n = len(self.nodes)
        at = int(np.searchsorted(self.nodes, origin))
        if at >= n or self.nodes[at] != origin:
            none = np.array([-1])
            return np.array([origin]), np.array([0.0]), none, none
        cost, link, before = np.full(n, np.inf), np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
        flat = np.zeros(n, dtype=bool)
        cost[at] = 0.0
        heap = [(0.0, at)]
        while heap:
            d, node = heapq.heappop(heap)
            if d > cost[node]:
                continue
            a, b = self.first[node], self.last[node]
            for to, w, name in zip(self.to[a:b].tolist(), self.cost[a:b].tolist(), self.link[a:b].tolist()):
                offer = d + w
                if offer < cost[to]:
                    cost[to], link[to], before[to], flat[to] = offer, name, node, w == 0
                    heapq.heappush(heap, (offer, to))
                elif offer == cost[to] and w > 0 and to != at and (flat[to] or name < link[to]):
                    link[to], before[to], flat[to] = name, node, False
        found = np.flatnonzero(cost < np.inf)
        return self.nodes[found], cost[found], link[found], np.where(before[found] >= 0, self.nodes[before[found]], -1)


def labels_grouped(links: DataFrame, origins: DataFrame, cost: str = "cost", cells: DataFrame | None = None) -> DataFrame:
    """GR-02, 18 by Dijkstra inside tasks, one origin at a time; beyond NETWORK_BYTES by :func:`cells.labels` where ``cells`` are given, else by the relational form."""
    if 28 * links.count() > NETWORK_BYTES:
        from . import cells as C

        return C.labels(links, origins, cells, cost) if cells is not None else labels(links, origins, cost)
    rows = links.select("link_id", "from_node_id", "to_node_id", cost).toPandas().to_numpy(dtype=float)
    shared = links.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        network = Network(shared.value)
        for pdf in batches:
            for origin in pdf["origin"]:
                node, best, link, before = network.search(int(origin))
                out = pd.DataFrame({"origin": origin, "node": node, "cost": best})
                for name, values in (("pred_link", link), ("pred_node", before)):
                    out[name] = pd.array(values, dtype="Int64")
                    out.loc[link < 0, name] = pd.NA
                yield out.astype({"pred_link": "Int32", "pred_node": "Int32"})

    kind = origins.schema["origin"].dataType.simpleString()
    return origins.select("origin").distinct().mapInPandas(run, f"origin {kind}, node {kind}, cost double, pred_link int, pred_node int")


def routes(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """GR-05, 07: ``o_zone_id, d_zone_id, links, cost`` of every pair (o, d) that the tree connects.

    Walks are doubled: each node knows the links from some ancestor, at first its
    predecessor, and takes over what that ancestor knows, so a walk of n links needs about
    log2(n) joins.  A walk that is still open after as many as the tree's nodes allow means
    a cycle, an error.
    """
    walk = tree.where("pred_link is not null").select(F.col("origin").alias("o"), F.col("node").alias("at"), F.col("pred_node").alias("up"), F.array("pred_link").alias("links"))
    walk = settle(walk)
    for _ in range(max(1, walk.select("at").distinct().count()).bit_length() + 1):
        if walk.where("up <> o").isEmpty():
            break
        more = walk.select("o", F.col("at").alias("up"), F.col("up").alias("_up"), F.col("links").alias("_links"))
        joined = walk.join(more, ["o", "up"], "left")  # an ancestor that is the origin knows no more
        walk = settle(joined.select("o", "at", F.coalesce("_up", "up").alias("up"), F.when(F.col("_links").isNotNull(), F.concat("_links", "links")).otherwise(F.col("links")).alias("links")))
    else:
        raise ValueError("a walk back does not reach its origin: the tree has a cycle")
    known = walk.select(F.col("o").alias("o_zone_id"), F.col("at").alias("d_zone_id"), "links")
    own = tree.where("pred_link is null").select(F.col("origin").alias("o_zone_id"), F.col("node").alias("d_zone_id"), F.array().cast("array<int>").alias("links"))
    cost = tree.select(F.col("origin").alias("o_zone_id"), F.col("node").alias("d_zone_id"), "cost")
    return pairs.select("o_zone_id", "d_zone_id").distinct().join(cost, ["o_zone_id", "d_zone_id"]).join(known.unionByName(own), ["o_zone_id", "d_zone_id"]).select("o_zone_id", "d_zone_id", "links", "cost")


def path_key(links_col: str):
    """GR-07, SET-03: identity of a path is its list of links."""
    return F.xxhash64(F.array_join(links_col, ";"))


def merge_paths(paths: DataFrame, keys: list[str], volume: str = "volume") -> DataFrame:
    """SET-03: union of paths by (keys, links); volumes of the same path add up."""
    return paths.groupBy(*keys, "links").agg(F.sum(volume).alias(volume))


def links_of_nodes(paths: DataFrame, links: DataFrame, key: str, nodes_col: str) -> DataFrame:
    """JN-05, SRC-17: ``key, pos, link_id`` of node sequences; a pair of nodes without a link makes the path invalid (dropped)."""
    at = paths.select(key, F.posexplode(nodes_col).alias("pos", "from_node_id"), F.col(nodes_col).alias("_n"))
    hops = at.where(F.col("pos") + 1 < F.size("_n")).withColumn("to_node_id", F.element_at("_n", F.col("pos") + 2)).drop("_n")
    found = hops.join(links.groupBy("from_node_id", "to_node_id").agg(F.max("link_id").alias("link_id")), ["from_node_id", "to_node_id"], "left")
    bad = found.where("link_id is null").select(key).distinct()
    return found.join(bad, key, "left_anti").select(key, "pos", "link_id")


def routes_grouped(links: DataFrame, origins: DataFrame, cost: str = "cost") -> DataFrame:
    """GR-07, 19: ``o_zone_id, d_zone_id, cost, links`` of every other node from each origin, searched and walked inside one task for each origin; beyond NETWORK_BYTES by the relational forms."""
    if 28 * links.count() > NETWORK_BYTES:
        tree = labels(links, origins, cost)
        return routes(tree, tree.where("origin <> node").select(F.col("origin").alias("o_zone_id"), F.col("node").alias("d_zone_id"))).select("o_zone_id", "d_zone_id", "cost", "links")
    shared = links.sparkSession.sparkContext.broadcast(links.select("link_id", "from_node_id", "to_node_id", cost).toPandas().to_numpy(dtype=float))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        network = Network(shared.value)
        for pdf in batches:
            for origin in pdf["origin"]:
                node, best, link, before = network.search(int(origin))
                entry = dict(zip(node.tolist(), zip(link.tolist(), before.tolist())))
                ends, ways = [], []
                for i, at in enumerate(node.tolist()):
                    way = []
                    while at != origin:
                        name, at = entry[at]
                        way.append(name)
                    if way:
                        ends.append(i)
                        ways.append(way[::-1])
                yield pd.DataFrame({"o_zone_id": origin, "d_zone_id": node[ends], "cost": best[ends], "links": ways})

    kind = origins.schema["origin"].dataType.simpleString()
    return origins.select("origin").distinct().mapInPandas(run, f"o_zone_id {kind}, d_zone_id {kind}, cost double, links array<int>")


def backward_labels(links: DataFrame, destinations: DataFrame, cost: str = "cost", wait: str | None = None) -> DataFrame:
    """GR-04, 05: ``destination, node, cost, next_link, next_node`` of every node that reaches a destination; ``wait`` names a column of real-time waits to add."""
    w = F.col(cost) + F.coalesce(F.col(wait), F.lit(0.0)) if wait else F.col(cost)
    turned = links.select("link_id", F.col("to_node_id").alias("from_node_id"), F.col("from_node_id").alias("to_node_id"), w.alias("cost"))
    tree = labels_grouped(turned, destinations.select(F.col("destination").alias("origin")))
    return tree.select(F.col("origin").alias("destination"), "node", "cost", F.col("pred_link").alias("next_link"), F.col("pred_node").alias("next_node"))


def turn_links(links: DataFrame, prohibited: DataFrame, origins: DataFrame, cost: str = "cost") -> DataFrame:
    """GR-03: a graph of links in which prohibited turns (``ib_link_id, ob_link_id``) are missing.

    Its nodes are links; an origin is entered by the negative of its number.  Labels of
    this graph cost the path up to and with the link that stands for the node.
    """
    a = links.select(F.col("link_id").alias("ib_link_id"), F.col("to_node_id").alias("via"))
    b = links.select(F.col("link_id").alias("ob_link_id"), F.col("from_node_id").alias("via"), F.col(cost).alias("cost"))
    turns = a.join(b, "via").join(prohibited, ["ib_link_id", "ob_link_id"], "left_anti").select(F.col("ob_link_id").alias("link_id"), F.col("ib_link_id").alias("from_node_id"), F.col("ob_link_id").alias("to_node_id"), "cost")
    starts = b.join(origins.select(F.col("origin").alias("via")), "via").select(F.col("ob_link_id").alias("link_id"), (-F.col("via")).alias("from_node_id"), F.col("ob_link_id").alias("to_node_id"), "cost")
    return turns.unionByName(starts)


def labels_with_turns(links: DataFrame, prohibited: DataFrame, origins: DataFrame, cost: str = "cost") -> DataFrame:
    """GR-03: ``origin, node, cost`` of the cheapest way that makes no prohibited turn."""
    tree = labels_grouped(turn_links(links, prohibited, origins, cost), origins.select((-F.col("origin")).alias("origin")))
    ends = tree.where("node > 0").join(links.select(F.col("link_id").alias("node"), F.col("to_node_id").alias("end")), "node")
    best = ends.groupBy((-F.col("origin")).alias("origin"), F.col("end").alias("node")).agg(F.min("cost").alias("cost"))
    return best.where("origin <> node")


def stitched(legs: DataFrame, key: str, order: str) -> DataFrame:
    """GR-12: one list of links for each activity chain from the lists of its legs."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("links").alias("l"))))
    return legs.groupBy(key).agg(F.flatten(F.transform(parts, lambda x: x["l"])).alias("links"))


def trimmed(paths: DataFrame, sequence: str, kind: str) -> DataFrame:
    """FN-25: ``sequence`` without its virtual ends: the first and last element of a free path, the last of a fixed route or one from an information origin, none of an activity chain (``kind`` free, fixed, info or activity)."""
    n = F.size(sequence)
    start = F.when(F.col(kind) == "free", 2).otherwise(1)
    length = F.when(F.col(kind) == "free", n - 2).when(F.col(kind).isin("fixed", "info"), n - 1).otherwise(n)
    return paths.withColumn(sequence, F.slice(sequence, start, F.greatest(length, F.lit(0))))


def from_info_zone(paths: DataFrame, info_zones: DataFrame) -> DataFrame:
    """FN-26: add ``info_origin``: 1 if the origin is an information zone."""
    flags = info_zones.select(F.col("zone_id").alias("o_zone_id")).distinct().withColumn("info_origin", F.lit(1))
    return paths.join(flags, "o_zone_id", "left").fillna(0, ["info_origin"])


def links_of_pairs(rows: DataFrame, links: DataFrame) -> DataFrame:
    """JN-04: add ``link_id`` by (from_node_id, to_node_id), the smallest of parallel links; rows without a link are left out."""
    one = links.groupBy("from_node_id", "to_node_id").agg(F.min("link_id").alias("link_id"))
    return rows.drop("link_id").join(one, ["from_node_id", "to_node_id"])


def numbered(paths: DataFrame) -> DataFrame:
    """WIN-10: ``path_no``: number of a path in its demand cell, from 0, by cost, then path id."""
    from pyspark.sql import Window as W

    order = W.partitionBy("o_zone_id", "d_zone_id", "agent_type").orderBy("path_cost", "path_id")
    return paths.withColumn("path_no", F.row_number().over(order) - 1)
