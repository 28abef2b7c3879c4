"""Assignment of several agent types in several periods over one network (GR-01, 02, 07..10, 21, FN-07, 08, FLT-09, 10, SRC-13, 17).

A class is an agent type in a period.  All classes share one network: each link of a
period has a bit for every type that may use it, and a type's cost is minutes, penalty
and toll over its value of time.  A search is one row, keyed by period, type and origin,
that carries the destinations its demand needs; it ends when the last of them is settled,
and only their routes leave the task.

Columns are paths with a volume and a state.  ``generated`` ones are scaled and shifted;
``fixed`` ones, routes that a file gives, and ``spliced`` ones, detours behind a message
sign, keep their volume.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import units
from ..session import settle
from . import cells as C
from . import paths as P

CELL = ["demand_period", "agent_type", "o_zone_id", "d_zone_id"]
GENERATED, FIXED, SPLICED = "generated", "fixed", "spliced"
#: Fixed value: minutes of a connector.
CONNECTOR_MINUTES = 0.0001
#: Types a mask can hold.
MOST_TYPES = 63


@dataclass(frozen=True)
class AgentType:
    """SRC-07: value of time per hour, passenger cars and persons a vehicle stands for."""

    name: str
    vot: float = 10.0
    pce: float = 1.0
    occ: float = 1.0


def types_of(table: DataFrame) -> list[AgentType]:
    """The agent types of a settings table, in order of name."""
    rows = table.select("agent_type", "vot", "pce", "occ").orderBy("agent_type").limit(MOST_TYPES + 1).collect()
    if len(rows) > MOST_TYPES:
        raise ValueError(f"at most {MOST_TYPES} agent types are supported")
    return [AgentType(*r) for r in rows]


def _by_type(types: list[AgentType], name: str) -> Column:
    pairs = [F.lit(x) for t in types for x in (t.name, float(getattr(t, name)))]
    return F.coalesce(F.create_map(*pairs)[F.col("agent_type")], F.lit(1.0)) if pairs else F.lit(1.0)


def source_of(zone: Column) -> Column:
    """The centroid in its part as origin: no link enters it."""
    return -2 * zone


def sink_of(zone: Column) -> Column:
    """The centroid in its part as destination: no link leaves it."""
    return -2 * zone - 1


def connected(links: DataFrame, access: DataFrame) -> DataFrame:
    """GR-21, FLT-09: ``links`` of every period with connectors between centroids and the access nodes (``zone_id, node_id``) of their zones.

    A centroid is two nodes, a source and a sink, so no path can pass through it.
    Connectors have negative numbers, no capacity limit and are open to all types.
    """
    a = access.select("zone_id", "node_id").where("node_id is not null and zone_id is not null").distinct()
    kind = lambda c: links.schema[c].dataType
    out = a.select((-2 * F.col("node_id")).alias("link_id"), source_of(F.col("zone_id")).alias("from_node_id"), F.col("node_id").alias("to_node_id"))
    back = a.select((-2 * F.col("node_id") - 1).alias("link_id"), F.col("node_id").alias("from_node_id"), sink_of(F.col("zone_id")).alias("to_node_id"))
    ends = out.unionByName(back).select(*[F.col(c).cast(kind(c)).alias(c) for c in ("link_id", "from_node_id", "to_node_id")])
    more = ends.crossJoin(F.broadcast(links.select("demand_period").distinct())).withColumn("connector_minutes", F.lit(CONNECTOR_MINUTES))
    return links.unionByName(more, allowMissingColumns=True)


def mask(types: list[AgentType], uses: Column) -> Column:
    """GR-01: a bit for each type that may use a link."""
    bits = [F.when(units.allowed(uses, F.lit(t.name)), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, t in enumerate(types)]
    out = F.lit(0).cast("long")
    for b in bits:
        out = out.bitwiseOR(b)
    return out


class Graph:
    """Links that one class may use, by node they leave; connectors are links with negative numbers."""

    def __init__(self, link: np.ndarray, start: np.ndarray, end: np.ndarray, cost: np.ndarray):
        order = np.lexsort((link, start))
        nodes, first = np.unique(start[order], return_index=True)
        last = np.append(first[1:], len(order))
        link, end, cost = link[order].tolist(), end[order].tolist(), cost[order].tolist()
        self.out = {n: list(zip(end[a:b], cost[a:b], link[a:b])) for n, a, b in zip(nodes.tolist(), first.tolist(), last.tolist())}

    def routes(self, origin: int, targets: list[int]) -> Iterator[tuple[int, float, list[int]]]:
        """(target, cost, links without connectors) of each target that can be reached.  Of equal costs the smaller predecessor link, of no cost itself only where no other gives the cost."""
        best, link, before, flat = {origin: 0.0}, {}, {}, {}
        left = set(targets) - {origin}
        heap = [(0.0, origin)]
        done = set()
        while heap and left:
            d, node = heapq.heappop(heap)
            if node in done:
                continue
            done.add(node)
            left.discard(node)
            for to, w, name in self.out.get(node, ()):
                offer = d + w
                old = best.get(to)
                if old is None or offer < old:
                    best[to], link[to], before[to], flat[to] = offer, name, node, w == 0
                    heapq.heappush(heap, (offer, to))
                elif offer == old and w > 0 and to != origin and (flat[to] or name < link[to]):
                    link[to], before[to], flat[to] = name, node, False
        for target in targets:
            if target in done and target != origin:
                way, at = [], target
                while at != origin:
                    if link[at] >= 0:
                        way.append(link[at])
                    at = before[at]
                yield target, best[target], way[::-1]


class Network:
    """The links of all periods and the tolls of all classes, as arrays for tasks; graphs of classes are made when first asked for."""

    def __init__(self, links: pd.DataFrame, tolls: pd.DataFrame, types: list[AgentType]):
        self.periods = {p: tuple(x[c].to_numpy() for c in ("link_id", "from_node_id", "to_node_id", "cost", "mask")) for p, x in links.groupby("demand_period")}
        self.tolls = {k: (x["link_id"].to_numpy(), x["toll"].to_numpy()) for k, x in tolls.groupby(["demand_period", "agent_type"])}
        self.types = {t.name: (i, t.vot) for i, t in enumerate(types)}
        self.graphs: dict[tuple[str, str], Graph] = {}

    def graph(self, period: str, agent_type: str) -> Graph:
        key = period, agent_type
        if key not in self.graphs:
            link, start, end, cost, bits = self.periods.get(period, (np.zeros(0, dtype=np.int64),) * 5)
            i, vot = self.types.get(agent_type, (None, 1.0))
            open_ = (bits >> i) & 1 == 1 if i is not None else np.zeros(len(link), dtype=bool)
            cost = cost.astype(float)
            if key in self.tolls:
                ids, toll = self.tolls[key]
                place = np.argsort(link)
                at = place[np.minimum(np.searchsorted(link[place], ids), max(len(link) - 1, 0))]
                hit = link[at] == ids
                np.add.at(cost, at[hit], toll[hit] / vot * 60.0)
            self.graphs[key] = Graph(link[open_], start[open_], end[open_], cost[open_])
        return self.graphs[key]


def searches(demand: DataFrame, centroids: bool) -> DataFrame:
    """``demand_period, agent_type, o_zone_id, origin, targets``: one row for each search, with the nodes it must reach; it starts at the origin zone's node, or at ``origin`` where the demand has such a column.  A column ``demand`` travels with its target."""
    o, d = F.col("o_zone_id").cast("long"), F.col("d_zone_id").cast("long")
    origin, target = (source_of(o), sink_of(d)) if centroids else (o, d)
    origin = F.col("origin").cast("long") if "origin" in demand.columns else origin
    carried = F.col("demand") if "demand" in demand.columns else F.lit(None).cast("double").alias("demand")
    one = F.struct(target.alias("target"), "d_zone_id", carried)
    return demand.groupBy("demand_period", "agent_type", "o_zone_id", origin.alias("origin")).agg(F.collect_set(one).alias("targets"))


def _schema(requests: DataFrame, link_kind: str) -> str:
    kind = lambda t: t.simpleString()
    o, d = requests.schema["o_zone_id"].dataType, requests.schema["targets"].dataType.elementType["d_zone_id"].dataType
    return f"demand_period string, agent_type string, o_zone_id {kind(o)}, d_zone_id {kind(d)}, cost double, links array<{link_kind}>, demand double"


def fits(links: DataFrame, tolls: DataFrame | None) -> bool:
    """Whether the rows of all periods and tolls, 40 bytes each, may be broadcast."""
    return 40 * (links.count() + (tolls.count() if tolls is not None else 0)) <= P.NETWORK_BYTES


_TOLLS = ["demand_period", "agent_type", "link_id", "toll"]


def best_routes(links: DataFrame, demand: DataFrame, types: list[AgentType], tolls: DataFrame | None = None, centroids: bool = False, cells: DataFrame | None = None) -> DataFrame:
    """GR-02, 07: ``CELL, cost, links`` of each pair of ``demand`` that its class can travel.

    ``links``: ``demand_period, link_id, from_node_id, to_node_id, cost, mask``; ``tolls``:
    ``demand_period, link_id, agent_type, toll``.  Beyond paths.NETWORK_BYTES each class is
    searched by the relational form, over ``cells`` (``node_id, cell``) where they are given.
    """
    requests = searches(demand, centroids)
    schema = _schema(requests, links.schema["link_id"].dataType.simpleString())
    if not fits(links, tolls):
        return _relational(settle(links), settle(requests), types, tolls, schema, cells).drop("demand")
    frame = links.select("demand_period", "link_id", "from_node_id", "to_node_id", "cost", "mask").toPandas()
    fees = tolls.select(*_TOLLS).toPandas() if tolls is not None else pd.DataFrame(columns=_TOLLS)
    return _searched(requests, frame, fees, types, schema).drop("demand")


def _searched(requests: DataFrame, links: pd.DataFrame, tolls: pd.DataFrame, types: list[AgentType], schema: str) -> DataFrame:
    shared = requests.sparkSession.sparkContext.broadcast((links, tolls, types))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        network = Network(*shared.value)
        for pdf in batches:
            for period, agent, zone, origin, targets in zip(pdf["demand_period"], pdf["agent_type"], pdf["o_zone_id"], pdf["origin"], pdf["targets"]):
                ends = {int(t["target"]): t for t in targets}
                found = list(network.graph(period, agent).routes(int(origin), sorted(ends)))
                if found:
                    yield pd.DataFrame({
                        "demand_period": period, "agent_type": agent, "o_zone_id": zone, "d_zone_id": [ends[t]["d_zone_id"] for t, _, _ in found],
                        "cost": [c for _, c, _ in found], "links": [w for _, _, w in found], "demand": [ends[t]["demand"] for t, _, _ in found],
                    }).astype({"demand": float})

    return requests.mapInPandas(run, schema)


def _relational(links: DataFrame, requests: DataFrame, types: list[AgentType], tolls: DataFrame | None, schema: str, cells: DataFrame | None) -> DataFrame:
    """The same routes by joins, one class after the other; classes are few."""
    out = requests.sparkSession.createDataFrame([], schema)
    rows = requests.select("demand_period", "agent_type", "o_zone_id", "origin", F.explode("targets").alias("t")).select("demand_period", "agent_type", "o_zone_id", "origin", "t.target", "t.d_zone_id", "t.demand")
    for i, t in enumerate(types):
        own = links.where(F.shiftright("mask", i).bitwiseAND(F.lit(1)) == 1)
        if tolls is not None:
            fee = tolls.where(F.col("agent_type") == t.name).groupBy("demand_period", "link_id").agg(F.sum("toll").alias("_toll"))
            own = own.join(fee, ["demand_period", "link_id"], "left").withColumn("cost", F.col("cost") + F.coalesce("_toll", F.lit(0.0)) / t.vot * 60.0)
        for (period,) in requests.where(F.col("agent_type") == t.name).select("demand_period").distinct().collect():
            mine = rows.where((F.col("agent_type") == t.name) & (F.col("demand_period") == period))
            ends = own.where(F.col("demand_period") == period).select("link_id", F.col("from_node_id").cast("long").alias("from_node_id"), F.col("to_node_id").cast("long").alias("to_node_id"), "cost")
            begin = mine.select("origin").distinct()
            tree = settle(C.labels(ends, begin, cells)) if cells is not None else P.labels(ends, begin)
            pairs = mine.where("origin <> target").select(F.col("origin").alias("o_zone_id"), F.col("target").alias("d_zone_id"))
            found = P.routes(tree, pairs).withColumnsRenamed({"o_zone_id": "origin", "d_zone_id": "target"})
            out = out.unionByName(mine.join(found, ["origin", "target"]).select(*CELL, "cost", F.filter("links", lambda x: x >= 0).alias("links"), "demand"))
    return out


def loads(columns: DataFrame, types: list[AgentType]) -> DataFrame:
    """AGG-01: ``demand_period, link_id, volume`` (passenger cars) and ``persons`` of columns."""
    v = F.col("volume")
    rows = columns.select("demand_period", F.explode("links").alias("link_id"), (v * _by_type(types, "pce")).alias("_v"), (v * _by_type(types, "occ")).alias("_p"))
    return rows.groupBy("demand_period", "link_id").agg(F.sum("_v").alias("volume"), F.sum("_p").alias("persons"))


def loaded(links: DataFrame, volumes: DataFrame) -> DataFrame:
    """Links of every period with their volume and persons, 0 where no column passes."""
    return links.drop("volume", "persons").join(volumes, ["demand_period", "link_id"], "left").fillna(0.0, ["volume", "persons"])


def costed(timed: DataFrame, types: list[AgentType]) -> DataFrame:
    """Links with ``cost`` (minutes and penalty, and a tiny share of the number so that best paths are unique) and ``mask``."""
    column = lambda c, d: F.coalesce(F.col(c), F.lit(d)) if c in timed.columns else F.lit(d)
    base = F.coalesce("connector_minutes", F.col("minutes")) if "connector_minutes" in timed.columns else F.col("minutes")
    cost = units.generalized_cost(base, column("penalty", 0.0), F.lit(0.0), F.lit(1.0))
    return timed.withColumns({"cost": cost + F.greatest("link_id", F.lit(0)) * F.lit(1e-9), "mask": mask(types, column("allowed_uses", ""))})


def merged(columns: DataFrame) -> DataFrame:
    """SET-03: one row for each cell, list of links and state."""
    return columns.groupBy(*CELL, "links", "state").agg(F.sum("volume").alias("volume"))


def fixed_columns(routes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-17: columns of fixed routes (``CELL, volume, nodes``), and ``CELL, volume`` of those that no links connect.

    Of parallel links the one with the greatest number stands for a pair of nodes.
    """
    rows = settle(routes.withColumn("_k", F.monotonically_increasing_id()))
    physical = links.select("link_id", "from_node_id", "to_node_id").distinct()
    hops = P.links_of_nodes(rows, physical, "_k", "nodes").groupBy("_k").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "link_id"))), lambda x: x["link_id"]).alias("links"))
    both = settle(rows.join(hops, "_k", "left"))
    kept = both.where("links is not null").select(*CELL, "links", F.lit(FIXED).alias("state"), "volume")
    return merged(kept), both.where("links is null").select(*CELL, "volume")


def assign(
    links: DataFrame, od: DataFrame, types: list[AgentType], iterations: int, minutes: Callable[[DataFrame], DataFrame],
    tolls: DataFrame | None = None, fixed: DataFrame | None = None, centroids: bool = False, cells: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """GR-08, 09, 14: successive averages over generated columns, all classes at once.

    Iteration k takes times from the volumes that iteration k-1 loaded, loads the columns
    found so far, scales generated ones by k/(k+1), and gives 1/(k+1) of each cell to the
    route that is best for its class, so flows found at k act on times at k+2.  Returns the
    columns (``CELL, links, state, volume``) and the trace (``iteration, total_minutes,
    least_minutes, gap``).  Each iteration writes one table, the columns.
    """
    spark = links.sparkSession
    demand = od.groupBy(*CELL).agg(F.sum("volume").alias("demand")).where("demand > 0")
    requests = settle(searches(demand, centroids))
    kind = links.schema["link_id"].dataType.simpleString()
    schema = _schema(requests, kind)
    links = settle(links)
    empty = spark.createDataFrame([], f"demand_period string, link_id {kind}, volume double, persons double")
    small = fits(links, tolls)
    fees = tolls.select(*_TOLLS).toPandas() if small and tolls is not None else pd.DataFrame(columns=_TOLLS)
    pool, state, trace = fixed, empty, []
    for k in range(iterations):
        timed = costed(minutes(loaded(links, state)), types)
        state = loads(pool, types) if pool is not None else empty
        if small:
            frame = timed.select("demand_period", "link_id", "from_node_id", "to_node_id", "cost", "mask", "minutes", "volume").toPandas()
            real = frame[frame["link_id"] >= 0]
            spent = float((real["minutes"] * real["volume"]).sum())
            share = _searched(requests, frame, fees, types, schema)
        else:
            timed = settle(timed)
            spent = timed.where("link_id >= 0").agg(F.sum(F.col("minutes") * F.col("volume"))).first()[0] or 0.0
            share = _relational(timed, requests, types, tolls, schema, cells)
        seen = Observation()
        share = share.observe(seen, F.sum(F.col("demand") * F.col("cost")).alias("least"))
        new = share.select(*CELL, "links", F.lit(GENERATED).alias("state"), (F.col("demand") / (k + 1)).alias("volume"))
        if pool is not None:
            scaled = F.when(F.col("state") == GENERATED, F.col("volume") * (k / (k + 1))).otherwise(F.col("volume"))
            new = new.unionByName(pool.withColumn("volume", scaled))
        pool = settle(merged(new))
        least = seen.get["least"] or 0.0
        trace.append((k, spent, least, (spent - least) / max(1e-5, least)))
    if pool is None:
        pool = spark.createDataFrame([], f"demand_period string, agent_type string, o_zone_id long, d_zone_id long, links array<{kind}>, state string, volume double")
    return pool, spark.createDataFrame(trace, "iteration int, total_minutes double, least_minutes double, gap double")


def column_costs(columns: DataFrame, timed: DataFrame, types: list[AgentType], tolls: DataFrame | None = None) -> DataFrame:
    """FN-07, 08: add ``path_cost``, the class's cost over a column's links, and ``path_id``, its identity."""
    rows = columns.drop("path_cost", "path_id").withColumn("path_id", P.path_key("links"))
    keys = [*CELL, "path_id", "state"]
    hops = rows.select(*keys, F.explode("links").alias("link_id")).join(timed.select("demand_period", "link_id", "cost"), ["demand_period", "link_id"])
    if tolls is not None:
        more = tolls.groupBy("demand_period", "link_id", "agent_type").agg(F.sum("toll").alias("_toll"))
        hops = hops.join(more, ["demand_period", "link_id", "agent_type"], "left").withColumn("cost", units.generalized_cost(F.col("cost"), F.lit(0.0), F.coalesce("_toll", F.lit(0.0)), _by_type(types, "vot")))
    sums = hops.groupBy(*keys).agg(F.sum("cost").alias("path_cost"))
    return rows.join(sums, keys, "left").fillna(0.0, ["path_cost"])


def column_update(columns: DataFrame, n: int, only: Column | None = None) -> DataFrame:
    """GR-10, SRT-06: one gradient projection step over generated columns with ``path_cost``; others keep their volume, as do those for which ``only`` does not hold (SC-05)."""
    from .assign import column_update as step

    free = (F.col("state") == GENERATED) & (F.coalesce(only, F.lit(False)) if only is not None else F.lit(True))
    return step(columns.where(free), n, CELL).unionByName(columns.where(~free))


def updates(columns: DataFrame, links: DataFrame, types: list[AgentType], steps: int, minutes: Callable[[DataFrame], DataFrame], tolls: DataFrame | None = None) -> DataFrame:
    """GR-10 repeated: costs follow the volumes of each step."""
    for n in range(steps):
        timed = costed(minutes(loaded(links, loads(columns, types))), types)
        columns = settle(column_update(column_costs(columns, timed, types, tolls), n).drop("path_cost", "path_id"))
    return columns


def unserved(od: DataFrame, columns: DataFrame) -> DataFrame:
    """FLT-10, JN-11: ``CELL, volume`` of demand cells without any column."""
    return od.groupBy(*CELL).agg(F.sum("volume").alias("volume")).join(columns.select(*CELL).distinct(), CELL, "left_anti")


def physical(columns: DataFrame) -> DataFrame:
    """FLT-10: columns that use at least one link; agents of others are never on the road."""
    return columns.where(F.size("links") > 0)


def agent_routes(agents: DataFrame, links: DataFrame, types: list[AgentType]) -> DataFrame:
    """GR-19: ``agents`` (CELL and any more columns) with ``cost, links`` of each agent's route; a cell is searched once, whatever its number of agents, and agents without a way have nulls."""
    cells_ = agents.select(*CELL).distinct().withColumn("volume", F.lit(1.0))
    return agents.join(best_routes(links, cells_, types), CELL, "left")
