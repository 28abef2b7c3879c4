"""Capacity and information scenarios (SC-01..07, GR-15..17, AGG-27, JN-18)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_within, settle
from . import assign, classes
from . import paths as P


def lane_changes(links: DataFrame, changes: DataFrame) -> DataFrame:
    """SC-01: lanes as given; period capacity in proportion; a link without lanes takes 1440 minutes.  ``changes`` has ``from_node_id, to_node_id, lanes``."""
    new = changes.groupBy("from_node_id", "to_node_id").agg(F.max("lanes").alias("_lanes"))
    rows = links.join(new, ["from_node_id", "to_node_id"], "left")
    lanes = F.coalesce("_lanes", F.col("lanes"))
    return rows.withColumns({
        "period_cap": F.when(F.col("_lanes").isNotNull(), F.col("period_cap") * F.try_divide(F.col("_lanes"), F.col("lanes"))).otherwise(F.col("period_cap")),
        "fftt": F.when(lanes < 0.01, 1440.0).otherwise(F.col("fftt")),
        "design_flag": F.when(F.col("_lanes").isNotNull(), -1).otherwise(0),
        "lanes": lanes,
    }).drop("_lanes")


def induced_delay(links: DataFrame, limit: float = 3.0) -> DataFrame:
    """SC-03: flag -2 where demand over capacity passes the limit and no design change applies."""
    return links.withColumn("design_flag", F.when((F.col("design_flag") == 0) & (F.col("doc") > limit), -2).otherwise(F.col("design_flag")))


def impacted_paths(paths: DataFrame, flags: DataFrame) -> DataFrame:
    """GR-15: add ``impacted``: 1 if a path uses a link with design flag -1."""
    rows = paths.withColumn("path_id", P.path_key("links"))
    keys = ["o_zone_id", "d_zone_id", "agent_type", "path_id"]
    hit = rows.select(*keys, F.explode("links").alias("link_id")).join(flags.where("design_flag = -1").select("link_id"), "link_id", "left_semi").select(*keys).distinct().withColumn("impacted", F.lit(1))
    return rows.join(hit, keys, "left").fillna(0, ["impacted"])


def impacted_od(paths: DataFrame) -> DataFrame:
    """AGG-27: ``o_zone_id, d_zone_id, impacted`` over all agent types."""
    return paths.groupBy("o_zone_id", "d_zone_id").agg(F.max("impacted").alias("impacted"))


def logit_split(options: DataFrame, keys: list[str], cost: str, volume: str, beta: float = -0.1) -> DataFrame:
    """GR-17: split a volume over options by exp(beta * cost), shifted by the least cost so that no exponent overflows."""
    least = options.groupBy(*keys).agg(F.min(cost).alias("_m"))
    rows = options.join(least, keys).withColumn("_e", F.exp(beta * (F.col(cost) - F.col("_m"))))
    total = rows.groupBy(*keys).agg(F.sum("_e").alias("_s"))
    return rows.join(total, keys).withColumn("volume", F.col(volume) * F.col("_e") / F.col("_s")).drop("_m", "_e", "_s")


def detours(paths: DataFrame, info_links: DataFrame, second: DataFrame, gain_minutes: float = 3.0, gain_share: float = 0.15, beta: float = -0.1) -> DataFrame:
    """GR-16, 17, JN-18: offer drivers who pass an information link before an affected one an unaffected way on.

    ``paths``: ``o_zone_id, d_zone_id, agent_type, links, volume, path_cost, impacted``;
    ``info_links``: ``link_id, zone_id`` (the zone the sign speaks for); ``second``: paths
    with ``o_zone_id`` the sign's zone.  An affected second-stage path sets the reference
    time; the cheapest unaffected one is spliced in after the information link where it
    saves more than both gains; the volume is split by logit.
    """
    at = paths.where("impacted = 1").withColumn("path_id", P.path_key("links")).select("*", F.posexplode("links").alias("pos", "link_id")).join(broadcast_within(info_links, 16), "link_id")
    first = at.groupBy("o_zone_id", "d_zone_id", "agent_type", "path_id").agg(F.min(F.struct("pos", "zone_id")).alias("i"))
    s = second.select(F.col("o_zone_id").alias("zone_id"), "d_zone_id", "agent_type", F.col("links").alias("more"), F.col("path_cost").alias("more_cost"), F.col("impacted").alias("more_hit"))
    ref = s.where("more_hit = 1").groupBy("zone_id", "d_zone_id", "agent_type").agg(F.min("more_cost").alias("ref"))
    best = s.where("more_hit = 0").groupBy("zone_id", "d_zone_id", "agent_type").agg(F.min(F.struct("more_cost", "more")).alias("b"))
    offers = ref.join(best, ["zone_id", "d_zone_id", "agent_type"]).where((F.col("ref") - F.col("b.more_cost") > gain_minutes) & (F.col("ref") - F.col("b.more_cost") > gain_share * F.col("ref")))
    keys = ["o_zone_id", "d_zone_id", "agent_type", "path_id"]
    rows = paths.withColumn("path_id", P.path_key("links")).join(first, keys).withColumn("zone_id", F.col("i.zone_id")).join(offers, ["zone_id", "d_zone_id", "agent_type"])
    stay = rows.select(*keys, "links", F.col("ref").alias("cost"), F.col("volume").alias("whole"))
    leave = rows.select(*keys, F.concat(F.slice("links", F.lit(1), F.col("i.pos") + 1), F.col("b.more")).alias("links"), F.col("b.more_cost").alias("cost"), F.col("volume").alias("whole"))
    split = logit_split(stay.unionByName(leave), keys, "cost", "whole", beta).select("o_zone_id", "d_zone_id", "agent_type", "links", "volume")
    kept = paths.withColumn("path_id", P.path_key("links")).join(rows.select(*keys), keys, "left_anti").select("o_zone_id", "d_zone_id", "agent_type", "links", "volume")
    return P.merge_paths(kept.unionByName(split), ["o_zone_id", "d_zone_id", "agent_type"])


def informed(paths: DataFrame, agent_types: DataFrame, info_zones: DataFrame) -> DataFrame:
    """SC-05, 07: add ``informed``: whether the path's drivers choose anew in a scenario.

    Types with ``real_time_info`` 0 never do, those with 1 do, those with 2 (message signs)
    do where the origin is an information zone.
    """
    kinds = agent_types.select("agent_type", "real_time_info")
    rows = P.from_info_zone(paths.join(broadcast_within(kinds, 40), "agent_type", "left"), info_zones)
    known = (F.col("real_time_info") == 1) | ((F.col("real_time_info") == 2) & (F.col("info_origin") == 1))
    return rows.withColumn("informed", F.coalesce(known, F.lit(False))).drop("real_time_info", "info_origin")


def reassign(links: DataFrame, paths: DataFrame, agent_types: DataFrame, info_zones: DataFrame, minutes: Callable[[DataFrame], DataFrame], iterations: int = 0) -> tuple[DataFrame, DataFrame]:
    """SC-04, 07: the scenario's assignment: iterations 0 to ``iterations`` over ``links`` after their changes.

    Each takes travel times at the current volumes, flags links of induced delay, and gives
    informed drivers 1/(k+1) of their cell's volume on the path that is best at those times,
    their earlier paths the rest; all others keep theirs.  Returns the paths
    (``o_zone_id, d_zone_id, agent_type, links, volume``) and the trace (``iteration,
    total_minutes, n_delayed``).
    """
    spark = links.sparkSession
    cell = ["o_zone_id", "d_zone_id", "agent_type"]
    told = settle(informed(paths, agent_types, info_zones).select(*cell, "links", "volume", "informed"))
    fixed, found = told.where("not informed").drop("informed"), told.where("informed").drop("informed")
    demand = settle(found.groupBy(*cell).agg(F.sum("volume").alias("demand")))
    origins = demand.select(F.col("o_zone_id").alias("origin")).distinct()
    trace = []
    for k in range(iterations + 1):
        timed = settle(induced_delay(minutes(assign.loaded(links, assign.link_volumes(fixed.unionByName(found))))))
        spent, delayed = timed.agg(F.sum(F.col("minutes") * F.col("volume")), F.count(F.when(F.col("design_flag") == -2, 1))).first()
        trace.append((k, float(spent or 0.0), int(delayed)))
        costed = timed.withColumn("cost", F.col("minutes") + F.col("link_id") * F.lit(1e-9))
        best = P.routes_grouped(costed, origins)
        new = demand.join(best, ["o_zone_id", "d_zone_id"]).select(*cell, "links", (F.col("demand") / (k + 1)).alias("volume"))
        kept = found.withColumn("volume", F.col("volume") * (k / (k + 1))).where("volume > 0")
        found = settle(P.merge_paths(kept.unionByName(new), cell))
    out = P.merge_paths(fixed.unionByName(found), cell)
    return out, spark.createDataFrame(trace, "iteration int, total_minutes double, n_delayed int")


def spliced(columns: DataFrame, timed: DataFrame, base: DataFrame, types: list[classes.AgentType], told: DataFrame, signs: DataFrame, tolls: DataFrame | None, centroids: bool) -> DataFrame:
    """SC-05, GR-16, 17: columns of ``told`` types that pass a message sign before an affected link, partly led on another way.

    ``timed`` and ``base``: links of all periods with ``cost`` and ``mask`` at the
    scenario's and the base case's times, ``timed`` also with ``design_flag``; ``signs``:
    ``link_id, node_id, zone_id``.  From each sign two ways on are searched for each
    destination that an affected column past it has: the one at the base case's times,
    which sets the reference time where it is affected, and the best one now.  What turns
    off has the state ``spliced`` and is not scaled later.
    """
    cell = classes.CELL
    key = F.concat_ws("\x1f", "demand_period", "agent_type")
    flags = timed.select("demand_period", "link_id", "design_flag")
    rows = settle(classes.column_costs(columns.join(told, "agent_type", "left_semi").where(F.col("state") == classes.GENERATED), timed, types, tolls))
    hops = rows.select(*cell, "path_id", F.explode("links").alias("link_id"))
    hit = hops.join(flags.where("design_flag = -1"), ["demand_period", "link_id"], "left_semi").select(*cell, "path_id").distinct()
    rows = rows.join(hit.withColumn("impacted", F.lit(1)), [*cell, "path_id"], "left").fillna(0, ["impacted"])
    passing = rows.where("impacted = 1").select(*cell, F.explode("links").alias("link_id")).join(broadcast_within(signs, 24), "link_id")
    wanted = passing.select("demand_period", "agent_type", F.col("zone_id").alias("o_zone_id"), F.col("node_id").alias("origin"), "d_zone_id").distinct()
    ways = classes.best_routes(timed, wanted, types, tolls, centroids).unionByName(classes.best_routes(base, wanted, types, tolls, centroids)).select(*cell, "links").distinct()
    ways = settle(ways)
    second = classes.column_costs(ways.withColumns({"state": F.lit(classes.GENERATED), "volume": F.lit(0.0)}), timed, types, tolls)
    second = settle(second)
    second_hit = second.select(*cell, "path_id", F.explode("links").alias("link_id")).join(flags.where("design_flag = -1"), ["demand_period", "link_id"], "left_semi").select(*cell, "path_id").distinct()
    second = second.join(second_hit.withColumn("impacted", F.lit(1)), [*cell, "path_id"], "left").fillna(0, ["impacted"])
    as_key = lambda df: df.withColumn("agent_type", key).drop("demand_period", "path_id", "state")
    led = detours(as_key(rows), signs.select("link_id", "zone_id"), as_key(second))
    split = F.split("agent_type", "\x1f")
    led = led.withColumn("demand_period", split[0]).withColumn("agent_type", split[1])
    known = rows.select(*cell, "links").withColumn("_own", F.lit(True))
    led = led.join(known, [*cell, "links"], "left").withColumn("state", F.when(F.col("_own"), classes.GENERATED).otherwise(classes.SPLICED)).drop("_own")
    rest = columns.join(rows.select(*cell, "links", "state"), [*cell, "links", "state"], "left_anti")
    return classes.merged(rest.select(*cell, "links", "state", "volume").unionByName(led.select(*cell, "links", "state", "volume")))


def reassign_classes(
    links: DataFrame, columns: DataFrame, types: list[classes.AgentType], minutes: Callable[[DataFrame], DataFrame], iterations: int = 0, *, base: DataFrame,
    informed_types: DataFrame | None = None, info_zones: DataFrame | None = None, tolls: DataFrame | None = None, centroids: bool = False, signs: DataFrame | None = None,
    rescaled: Callable[[DataFrame], DataFrame] | None = None, shifts: int = 5,
) -> tuple[DataFrame, DataFrame]:
    """SC-02, 04, 05, 07 over the columns of :func:`classes.assign`; ``links`` after their changes, ``base`` before.

    ``rescaled`` applies the scenario's demand factors to the volumes.  Drivers of message
    sign types on affected columns may be led off behind a sign.  Then iterations 0 to
    ``iterations`` let informed drivers choose anew at the current times, as
    :func:`reassign` does; fixed and spliced columns keep their volume.  Last, ``shifts``
    gradient steps move volume between the columns of informed types in pairs that a
    changed link affects, and of no others.  Returns the columns and the trace
    (``iteration, total_minutes, n_delayed``).
    """
    spark = links.sparkSession
    cell = classes.CELL
    empty = spark.createDataFrame([], "agent_type string, real_time_info int")
    kinds = informed_types.select("agent_type", "real_time_info") if informed_types is not None else empty
    zones = info_zones if info_zones is not None else spark.createDataFrame([], "zone_id int")
    if rescaled is not None:
        columns = settle(rescaled(columns).select(*cell, "links", "state", "volume"))
    at = lambda net, cols: classes.costed(induced_delay(minutes(classes.loaded(net.withColumn("design_flag", F.coalesce("design_flag", F.lit(0))) if "design_flag" in net.columns else net.withColumn("design_flag", F.lit(0)), classes.loads(cols, types)))), types)
    if signs is not None and not signs.isEmpty():
        told = kinds.where("real_time_info = 2").select("agent_type").distinct()
        columns = settle(spliced(columns, settle(at(links, columns)), settle(at(base, columns)), types, told, signs, tolls, centroids))
    marked = settle(informed(columns, kinds, zones).select(*cell, "links", "state", "volume", "informed"))
    moves = F.col("informed") & (F.col("state") == classes.GENERATED)
    kept, found = marked.where(~moves).drop("informed"), marked.where(moves).drop("informed")
    cells = settle(found.groupBy(*cell).agg(F.sum("volume").alias("demand")))
    trace = []
    for k in range(iterations + 1):
        timed = settle(at(links, kept.unionByName(found)))
        spent, delayed = timed.where("link_id >= 0").agg(F.sum(F.col("minutes") * F.col("volume")), F.count(F.when(F.col("design_flag") == -2, 1))).first()
        trace.append((k, float(spent or 0.0), int(delayed)))
        # a cell whose destination can no longer be reached keeps its columns
        best = cells.join(classes.best_routes(timed, cells, types, tolls, centroids), cell)
        new = best.select(*cell, "links", F.lit(classes.GENERATED).alias("state"), (F.col("demand") / (k + 1)).alias("volume"))
        share = F.when(F.col("_new"), F.col("volume") * (k / (k + 1))).otherwise(F.col("volume"))
        old = found.join(best.select(*cell).withColumn("_new", F.lit(True)), cell, "left").withColumn("volume", share).drop("_new").where("volume > 0")
        found = settle(classes.merged(old.unionByName(new)))
    flags = links.select("demand_period", "link_id", "design_flag").where("design_flag = -1")
    for n in range(shifts):
        timed = at(links, kept.unionByName(found))
        hit = found.select(*cell, F.explode("links").alias("link_id")).join(flags, ["demand_period", "link_id"], "left_semi").select(*cell).distinct().withColumn("_hit", F.lit(True))
        rows = classes.column_costs(found, timed, types, tolls).join(hit, cell, "left")
        found = settle(classes.column_update(rows, n, F.col("_hit")).select(*cell, "links", "state", "volume"))
    out = classes.merged(kept.unionByName(found))
    return out, spark.createDataFrame(trace, "iteration int, total_minutes double, n_delayed int")


def scenario_log(links: DataFrame, changes: DataFrame, kind: str = "sa") -> DataFrame:
    """SNK-18: ``scenario_type, link_id, lanes_before, lanes_after`` of each changed link."""
    new = changes.groupBy("from_node_id", "to_node_id").agg(F.max("lanes").alias("lanes_after"))
    return links.join(new, ["from_node_id", "to_node_id"]).select(F.lit(kind).alias("scenario_type"), "link_id", F.col("lanes").alias("lanes_before"), "lanes_after")


def incident_capacity(links: DataFrame, incidents: DataFrame, minutes: int) -> DataFrame:
    """SC-08: ``link_id, minute, capacity``: vehicles a minute, cut to the incident's share inside its window; ``incidents`` has ``link_id, start_min, end_min, share``."""
    rows = links.select("link_id", (F.col("lane_capacity") * F.col("lanes") / 60.0).alias("full"), F.explode(F.sequence(F.lit(0), F.lit(minutes - 1))).alias("minute"))
    cut = broadcast_within(incidents.groupBy("link_id", "start_min", "end_min").agg(F.min("share").alias("share")), 28)
    hit = rows.join(cut, "link_id", "left").withColumn("_s", F.when((F.col("minute") >= F.col("start_min")) & (F.col("minute") < F.col("end_min")), F.col("share")).otherwise(1.0))
    return hit.groupBy("link_id", "minute").agg((F.first("full") * F.min("_s")).alias("capacity"))
