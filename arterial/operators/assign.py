"""Traffic assignment (GR-08..10, 13, 14, AGG-01, 04, FN-07, 08)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from . import paths as P


def link_volumes(paths: DataFrame, by: tuple[str, ...] = (), pce: str | None = None, occupancy: str | None = None) -> DataFrame:
    """AGG-01, JN-08: ``link_id`` (and ``by``), ``volume`` (in passenger cars) and ``persons`` from path volumes."""
    v = F.col("volume")
    rows = paths.select(*by, F.explode("links").alias("link_id"), (v * F.col(pce) if pce else v).alias("_v"), (v * F.col(occupancy) if occupancy else v).alias("_p"))
    return rows.groupBy("link_id", *by).agg(F.sum("_v").alias("volume"), F.sum("_p").alias("persons"))


def loaded(links: DataFrame, volumes: DataFrame) -> DataFrame:
    """Links with their volume and persons, 0 where no path passes."""
    return links.drop("volume", "persons").join(volumes.select("link_id", "volume", "persons"), "link_id", "left").fillna(0.0, ["volume", "persons"])


def column_generation(links: DataFrame, od: DataFrame, iterations: int, minutes: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """GR-08, 09, 14: method of successive averages over generated paths.

    ``minutes`` adds travel time to links that have ``volume``.  Iteration k takes
    times from the link volumes that iteration k-1 loaded, loads the paths found so
    far, scales them by k/(k+1), and gives 1/(k+1) of each demand to the path that is
    best at those times, so flows found at k act on times at k+2.  One period, all links
    open to all types: :func:`classes.assign` is the general form.  Returns the paths
    (``o_zone_id, d_zone_id, agent_type, links, volume``) and the trace (``iteration,
    total_minutes, least_minutes, gap``).
    """
    from . import classes

    one = od.withColumn("demand_period", F.lit("all"))
    names = od.select("agent_type").distinct().orderBy("agent_type").limit(classes.MOST_TYPES).collect()
    net = links.drop("allowed_uses", "penalty").withColumn("demand_period", F.lit("all"))
    columns, trace = classes.assign(net, one, [classes.AgentType(r[0]) for r in names], iterations, minutes)
    return columns.select("o_zone_id", "d_zone_id", "agent_type", "links", "volume"), trace


def link_based(links: DataFrame, od: DataFrame, iterations: int, minutes: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """GR-13: link volumes by successive averages of all-or-nothing loads; paths are not kept."""
    origins = od.select(F.col("o_zone_id").alias("origin")).distinct()
    state = settle(links.withColumns({"volume": F.lit(0.0), "persons": F.lit(0.0)}))
    for k in range(iterations):
        costed = minutes(state).withColumn("cost", F.col("minutes") + F.col("link_id") * 1e-9)
        best = P.routes_grouped(settle(costed), origins)
        load = link_volumes(od.join(best, ["o_zone_id", "d_zone_id"]).select("links", "volume"))
        new = loaded(links, load).select("link_id", F.col("volume").alias("v1"), F.col("persons").alias("p1"))
        mixed = state.join(new, "link_id")
        state = settle(mixed.withColumns({c: F.col(c) * (k / (k + 1)) + F.col(n) / (k + 1) for c, n in (("volume", "v1"), ("persons", "p1"))}).drop("v1", "p1"))
    return state


def path_costs(paths: DataFrame, links: DataFrame, cost: str = "minutes") -> DataFrame:
    """Add ``path_cost``, the sum over the path's links, and ``path_id``, its identity."""
    rows = paths.drop("path_cost").withColumn("path_id", P.path_key("links"))
    keys = ["o_zone_id", "d_zone_id", "agent_type", "path_id"]
    sums = rows.select(*keys, F.explode("links").alias("link_id")).join(links.select("link_id", F.col(cost).alias("_c")), "link_id").groupBy(*keys).agg(F.sum("_c").alias("path_cost"))
    return rows.join(sums, keys)


def column_update(paths: DataFrame, n: int, cell: Sequence[str] = ("o_zone_id", "d_zone_id", "agent_type")) -> DataFrame:
    """GR-10, SRT-06: one gradient projection step over paths with ``path_cost``.

    In each demand cell every path but the cheapest gives ``demand / (n + 2)`` times
    its relative cost gap, all of its volume at most (also where the gap is above 180),
    to the cheapest; ties go to the smaller path id.
    """
    cell = list(cell)
    best = paths.groupBy(*cell).agg(F.min(F.struct("path_cost", "path_id")).alias("b"), F.sum("volume").alias("demand"))
    rows = paths.join(best, cell)
    gap = (F.col("path_cost") - F.col("b.path_cost")) / F.greatest(F.lit(1e-4), F.col("b.path_cost"))
    shift = F.when(F.col("path_id") == F.col("b.path_id"), 0.0).when(gap > 180, F.col("volume")).otherwise(F.least(F.col("volume"), F.col("demand") / (n + 2) * gap))
    rows = rows.withColumn("shift", shift)
    gained = rows.groupBy(*cell).agg(F.sum("shift").alias("gained"))
    out = rows.join(gained, cell).withColumn("volume", F.col("volume") - F.col("shift") + F.when(F.col("path_id") == F.col("b.path_id"), F.col("gained")).otherwise(0.0))
    return out.drop("b", "shift", "gained", "demand")


def column_updates(paths: DataFrame, links: DataFrame, steps: int, minutes: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """GR-10 repeated: costs follow the volumes of each step."""
    for n in range(steps):
        timed = minutes(loaded(links, link_volumes(paths)))
        paths = settle(column_update(path_costs(paths.drop("path_cost", "path_id"), timed), n))
    return paths


def ue_gap(paths: DataFrame) -> DataFrame:
    """OD-05: ``gap``, the sum over paths of volume times cost above the cell's least, and ``total``."""
    cell = ["o_zone_id", "d_zone_id", "agent_type"]
    least = paths.groupBy(*cell).agg(F.min("path_cost").alias("least"))
    return paths.join(least, cell).agg(F.sum(F.col("volume") * (F.col("path_cost") - F.col("least"))).alias("gap"), F.sum(F.col("volume") * F.col("least")).alias("total"))
