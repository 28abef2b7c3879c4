"""Demand (DM-01..12, FLT-04, 05, 12, WIN-01, JN-02, 09, 10, 16)."""

from __future__ import annotations

from math import floor

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry, units
from . import access, ranges


def known_pairs(demand: DataFrame, zones: DataFrame) -> DataFrame:
    """JN-02, FLT-04, 05: positive demand between two different known zones."""
    z = zones.select("zone_id").distinct()
    rows = demand.where("o_zone_id <> d_zone_id and volume > 0")
    return rows.join(z.withColumnRenamed("zone_id", "o_zone_id"), "o_zone_id", "left_semi").join(z.withColumnRenamed("zone_id", "d_zone_id"), "d_zone_id", "left_semi")


def unknown_rows(demand: DataFrame, zones: DataFrame) -> DataFrame:
    """JN-02: demand rows with an unknown end."""
    z = zones.select("zone_id").distinct()
    a = demand.join(z.withColumnRenamed("zone_id", "o_zone_id"), "o_zone_id", "left_anti")
    b = demand.join(z.withColumnRenamed("zone_id", "o_zone_id"), "o_zone_id", "left_semi").join(z.withColumnRenamed("zone_id", "d_zone_id"), "d_zone_id", "left_anti")
    return a.unionByName(b)


def before_sentinel(demand: DataFrame, order: str, limit: float = -99.0) -> DataFrame:
    """FLT-12: rows of one file before its first volume below ``limit``; ``order`` numbers the file's rows, so the cut is one aggregate, not a global window."""
    cut = demand.where(F.col("volume") < limit).agg(F.min(order).alias("_cut"))
    return demand.crossJoin(F.broadcast(cut)).where(F.col("_cut").isNull() | (F.col(order) < F.col("_cut"))).drop("_cut")


def accessibility(zones: DataFrame, mph: float = 30.0) -> DataFrame:
    """DM-01, JN-10: ``o_zone_id, d_zone_id, mile, minute`` of every ordered pair of zones.

    All pairs are the result itself; zones are the small dimension of a network.
    """
    a = zones.select(F.col("zone_id").alias("o_zone_id"), F.col("x_coord").alias("x1"), F.col("y_coord").alias("y1"))
    b = zones.select(F.col("zone_id").alias("d_zone_id"), F.col("x_coord").alias("x2"), F.col("y_coord").alias("y2"))
    rows = a.join(b, F.col("o_zone_id") != F.col("d_zone_id"))
    rows = rows.withColumn("mile", geometry.haversine(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")) / units.METRES)
    return rows.select("o_zone_id", "d_zone_id", "mile", (F.col("mile") / mph * 60).alias("minute"))


def distribution(access: DataFrame, zones: DataFrame, cutoff_minutes: float = 40.0, decay: float = 0.0) -> DataFrame:
    """DM-02: trips of each pair: production times the destination's attraction over the attraction within the cutoff.

    Destinations beyond the cutoff still get trips; ``decay`` (per minute, 0 for none)
    optionally weighs attractions by distance.
    """
    p = zones.select(F.col("zone_id").alias("o_zone_id"), "production")
    a = zones.select(F.col("zone_id").alias("d_zone_id"), "attraction")
    rows = access.join(p, "o_zone_id").join(a, "d_zone_id")
    pull = F.col("attraction") * F.exp(-F.lit(decay) * F.col("minute")) if decay else F.col("attraction")
    near = rows.groupBy("o_zone_id").agg(F.sum(F.when(F.col("minute") <= cutoff_minutes, pull)).alias("near"))
    return rows.join(near, "o_zone_id").select("o_zone_id", "d_zone_id", (F.col("production") * pull / F.greatest(F.lit(1e-5), "near")).alias("trips"))


def district_factors(demand: DataFrame, zones: DataFrame, factors: DataFrame, file_scale: float = 1.0) -> DataFrame:
    """DM-05, 06, SC-02: volume times the file's scale and one district factor.

    ``factors`` has ``scenario_type`` (o_based, d_based or od_based), ``o_district_id,
    d_district_id, scale_factor``; the factor of the pair replaces the destination's,
    which replaces the origin's.
    """
    z = zones.select("zone_id", "district_id")
    rows = demand.join(z.select(F.col("zone_id").alias("o_zone_id"), F.col("district_id").alias("o_district_id")), "o_zone_id", "left").join(z.select(F.col("zone_id").alias("d_zone_id"), F.col("district_id").alias("d_district_id")), "d_zone_id", "left")
    last = lambda kind, keys, name: factors.where(F.col("scenario_type") == kind).groupBy(*keys).agg(F.max("scale_factor").alias(name))
    rows = rows.join(last("o_based", ["o_district_id"], "_o"), "o_district_id", "left").join(last("d_based", ["d_district_id"], "_d"), "d_district_id", "left").join(last("od_based", ["o_district_id", "d_district_id"], "_od"), ["o_district_id", "d_district_id"], "left")
    return rows.withColumn("volume", F.col("volume") * file_scale * F.coalesce("_od", "_d", "_o", F.lit(1.0))).drop("_o", "_d", "_od")


def departure_profile(counts: DataFrame, slot: str, n: str) -> DataFrame:
    """WIN-01: ``slot, ratio, cum`` of a profile of slots (288 a day at most); cum is the share before the slot's end."""
    total = counts.agg(F.sum(n).alias("_t"))
    rows = counts.crossJoin(F.broadcast(total)).withColumn("ratio", F.col(n) / F.col("_t"))
    running = F.sum(n).over(W.orderBy(slot).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("cum", running / F.col("_t")).select(slot, "ratio", "cum")


def vehicles(paths: DataFrame, profile: DataFrame, slot: str = "slot5", slot_minutes: float = 5.0) -> DataFrame:
    """DM-09, 10, SIM-04: one row per vehicle of each path, with its departure minute.

    A path of volume v has floor(v + 0.5) vehicles; vehicle i of n leaves where the
    profile's cumulative share reaches i / n, linearly inside the slot.  The profile,
    one short array, is broadcast.
    """
    arr = profile.agg(F.array_sort(F.collect_list(F.struct(F.col(slot).alias("s"), F.col("cum"), F.col("ratio")))).alias("_profile"))
    rows = paths.withColumn("n", F.floor(F.col("volume") + 0.5).cast("int")).where("n > 0")
    rows = rows.withColumn("v", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).crossJoin(F.broadcast(arr))
    share = F.col("v") / F.col("n")
    hit = F.try_element_at(F.filter("_profile", lambda p: p["cum"] > share), F.lit(1))
    rows = rows.withColumn("_hit", hit)
    within = F.try_divide(share - (F.col("_hit.cum") - F.col("_hit.ratio")), F.col("_hit.ratio"))
    return rows.withColumn("depart_min", F.col("_hit.s") + within * slot_minutes).drop("_profile", "_hit")


def subarea_zones(nodes: DataFrame, demand: DataFrame, ring: list[tuple[float, float]]) -> DataFrame:
    """DM-07, JN-17: ``zone_id, inside, impact``: volume of trips that start, end or cross in the subarea, by origin zone."""
    n = nodes.withColumn("inside", geometry.in_polygon(F.col("x_coord"), F.col("y_coord"), ring))
    o = n.select(F.col("zone_id").alias("o_zone_id"), F.col("x_coord").alias("x1"), F.col("y_coord").alias("y1"), F.col("inside").alias("o_in"))
    d = n.select(F.col("zone_id").alias("d_zone_id"), F.col("x_coord").alias("x2"), F.col("y_coord").alias("y2"), F.col("inside").alias("d_in"))
    rows = demand.join(o, "o_zone_id").join(d, "d_zone_id")
    touches = F.col("o_in") | F.col("d_in") | geometry.crosses_ring(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), ring)
    impact = rows.groupBy(F.col("o_zone_id").alias("zone_id")).agg(F.sum(F.when(touches, F.col("volume")).otherwise(0.0)).alias("impact"))
    return n.select("zone_id", "inside").join(impact, "zone_id", "left").fillna(0.0, ["impact"])


def cutoff_value(impacts: DataFrame, value: str, share: float = 0.25, least: int = 100) -> DataFrame:
    """SRT-02: ``cutoff, n_kept``: the value at rank n - max(share * n, least), descending, the smallest value if that rank is below 1; no row without positive values.

    The rank is found by :func:`ranges.value_at`.
    """
    v = impacts.where(F.col(value) > 0).select(F.col(value).cast("double").alias("_v"))
    n = v.count()
    at = max(1, floor(n - max(share * n, float(least)))) if n - max(share * n, float(least)) >= 1 else n
    cutoff = ranges.value_at(v, "_v", at)
    kept = v.where(F.col("_v") >= F.lit(cutoff)).agg(F.count("*").alias("n_kept"))
    return kept.where("n_kept > 0").select(F.lit(cutoff).cast("double").alias("cutoff"), "n_kept")


def nearest(points: DataFrame, seeds: DataFrame, key: str, seed: str) -> DataFrame:
    """JN-16, DM-08: ``key, seed`` of the nearest seed to each point, ties to the smaller seed.  Seeds are few (about 20): one array that each point searches."""
    listed = seeds.agg(F.sort_array(F.collect_list(F.struct(F.col(seed).alias("s"), F.col("x_coord").alias("x"), F.col("y_coord").alias("y")))).alias("_seeds"))
    away = lambda p: F.struct(F.round(geometry.haversine(F.col("x_coord"), F.col("y_coord"), p["x"], p["y"]), 3).alias("d"), p["s"].alias("s"))
    return points.crossJoin(F.broadcast(listed)).select(key, F.array_min(F.transform("_seeds", away))["s"].alias(seed))


def k_nearest(zones: DataFrame, nodes: DataFrame, k: int = 4, metres: float = 2000.0) -> DataFrame:
    """JN-13, SRT-03: ``zone_id, node_id, rank, metres`` of the k nearest nodes within a distance."""
    return access.ranked(access.near_pairs(zones, nodes, "zone_id", "node_id", metres), "zone_id", "node_id", k)


def sampled_zones(nodes: DataFrame, every: int = 10) -> DataFrame:
    """DM-11: boundary nodes become zones; without any, every n-th node does."""
    marked = nodes.where("is_boundary = 1")
    chosen = marked if not marked.isEmpty() else nodes.where(F.pmod(F.col("node_id"), F.lit(every)) == 0)
    return chosen.select("node_id", F.col("node_id").alias("zone_id"), "x_coord", "y_coord")


def node_production(nodes: DataFrame, total: float = 5000.0) -> DataFrame:
    """DM-12: an even share of the zone's production for each activity node."""
    n = nodes.groupBy("zone_id").agg(F.count("*").alias("_n"))
    return nodes.join(n, "zone_id").withColumn("production", F.lit(total) / F.col("_n")).drop("_n")


def search_origins(demand: DataFrame, info_zones: DataFrame, absorbed: DataFrame, least: float = 0.001) -> DataFrame:
    """FLT-07: ``zone_id, volume, info`` of the origins worth searching: more than the least demand, or an information zone, and not absorbed in a super zone."""
    total = demand.groupBy(F.col("o_zone_id").alias("zone_id")).agg(F.sum("volume").alias("volume"))
    flags = info_zones.select("zone_id").distinct().withColumn("info", F.lit(1))
    rows = total.join(flags, "zone_id", "full").fillna(0.0, ["volume"]).fillna(0, ["info"])
    return rows.where((F.col("volume") > least) | (F.col("info") == 1)).join(absorbed.select("zone_id").distinct(), "zone_id", "left_anti")


def by_period(demand: DataFrame, periods: DataFrame) -> DataFrame:
    """JN-09: every demand cell in every period with its share: ``periods`` has ``demand_period, share``, a handful of rows."""
    return demand.crossJoin(F.broadcast(periods)).withColumn("volume", F.col("volume") * F.col("share")).drop("share")


def loading_window(periods: DataFrame, files: DataFrame) -> DataFrame:
    """AGG-23, FLT-08: ``start_min, end_min, n`` over the periods that some demand file names."""
    used = periods.join(files.select("demand_period").distinct(), "demand_period", "left_semi")
    return used.agg(F.min("start_min").alias("start_min"), F.max("end_min").alias("end_min"), F.count("*").alias("n"))
