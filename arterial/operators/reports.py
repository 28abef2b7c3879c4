"""Aggregates, windows and rankings of results (AGG-02..27, WIN-02..07, 09, SRT-01, JN-11, 12, SET-02, 04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import units
from ..session import broadcast_within
from . import ranges


def od_totals(demand: DataFrame) -> DataFrame:
    """AGG-02, SRC-19: ``level, o_zone_id, d_zone_id, volume`` by cell, by origin and overall, in one pass of grouping sets."""
    o, d = F.col("o_zone_id"), F.col("d_zone_id")
    sums = demand.groupingSets([[o, d], [o], []], o, d).agg(F.sum("volume").alias("volume"), F.grouping_id().alias("_g"))
    return sums.select(F.when(F.col("_g") == 0, "cell").when(F.col("_g") == 1, "origin").otherwise("all").alias("level"), "o_zone_id", "d_zone_id", "volume")


def network_summary(links: DataFrame) -> DataFrame:
    """AGG-03: per link type: links, mean speed, length and capacity."""
    return links.groupBy("link_type").agg(F.count("*").alias("n"), F.avg("free_speed").alias("avg_speed"), F.sum(units.miles(F.col("length_m"))).alias("miles"), F.sum(F.col("lane_capacity") * F.col("lanes")).alias("capacity"))


def corridors(performance: DataFrame, name: Column, scenario: Column | None = None) -> DataFrame:
    """AGG-05, SET-02: means by corridor; links with a scenario code count once more under their own name."""
    rows = performance.withColumn("corridor", name)
    if scenario is not None:
        extra = performance.where(scenario.isNotNull()).withColumn("corridor", F.concat(scenario, F.lit(" link_id:"), F.col("link_id").cast("string")))
        rows = rows.unionByName(extra)
    return rows.groupBy("corridor").agg(F.count("*").alias("n"), F.avg("volume").alias("vol"), F.avg("speed").alias("speed"), F.avg("doc").alias("doc"), F.max("p").alias("max_p"))


def districts(paths: DataFrame, zones: DataFrame) -> DataFrame:
    """AGG-06, 12: per origin district and agent type: volume, and mean minutes and miles over the volume; ``paths`` has ``volume, path_cost, path_miles``."""
    z = zones.select(F.col("zone_id").alias("o_zone_id"), "district_id")
    v = F.col("volume")
    agg = paths.join(z, "o_zone_id").groupBy("district_id", "agent_type").agg(F.sum("volume").alias("volume"), F.sum(v * F.col("path_cost")).alias("_t"), F.sum(v * F.col("path_miles")).alias("_d"))
    per = lambda c: F.try_divide(F.col(c), F.col("volume"))
    return agg.select("district_id", "agent_type", "volume", per("_t").alias("avg_time"), per("_d").alias("avg_mile"))


def class_means(rows: DataFrame, keys: list[str], params: list[str]) -> DataFrame:
    """AGG-07: mean parameters of a class."""
    return rows.groupBy(*keys).agg(*[F.avg(p).alias(p) for p in params])


def inside_outside(demand: DataFrame, flags: DataFrame) -> DataFrame:
    """AGG-08: volumes from and to inside and outside of an area, as a matrix."""
    o, d = flags.select(F.col("zone_id").alias("o_zone_id"), F.col("inside").alias("o_in")), flags.select(F.col("zone_id").alias("d_zone_id"), F.col("inside").alias("d_in"))
    rows = demand.join(o, "o_zone_id").join(d, "d_zone_id").withColumn("to_", F.when(F.col("d_in"), "inside").otherwise("outside"))
    return rows.groupBy(F.when(F.col("o_in"), "inside").otherwise("outside").alias("from_")).pivot("to_", ["inside", "outside"]).agg(F.sum("volume"))


def od_weighted(paths: DataFrame, types: list[str]) -> DataFrame:
    """AGG-10: per OD: volume, means of miles and minutes over the volume, and the minutes of each agent type."""
    v = F.col("volume")
    mean = lambda c, w: F.try_divide(F.sum(w * F.col(c)), F.sum(w))
    each = [mean("path_cost", F.when(F.col("agent_type") == t, v)).alias(f"time_{t}") for t in types]
    return paths.groupBy("o_zone_id", "d_zone_id").agg(F.sum(v).alias("volume"), mean("path_miles", v).alias("avg_mile"), mean("path_cost", v).alias("avg_time"), *each)


def count_errors(loads: DataFrame, counts: DataFrame, *by: str) -> DataFrame:
    """AGG-11, 13: MAE, MAPE and MPE of loads against counts of 1 or more, for each of ``by``; upper bounds count only where exceeded."""
    rows = counts.where("obs_count >= 1").join(loads, "link_id").withColumn("_d", F.col("volume") - F.col("obs_count"))
    rows = rows.where((F.col("upper_bound_flag") == 0) | (F.col("_d") > 0))
    d, o = F.col("_d"), F.col("obs_count")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs(d)).alias("mae"), (F.avg(F.abs(d) / o) * 100).alias("mape"), (F.avg(d / o) * 100).alias("mpe"))


def moe_totals(performance: DataFrame) -> DataFrame:
    """AGG-14: totals of VMT, VHT, PMT and PHT, the speed they mean, and VKT."""
    agg = performance.agg(*[F.sum(c).alias(c) for c in ("vmt", "vht", "pmt", "pht")])
    return agg.withColumn("mph", F.try_divide(F.col("vmt"), F.col("vht"))).withColumn("vkt", F.col("vmt") * units.KM_PER_MILE)


def connectivity(demand: DataFrame, paths: DataFrame) -> DataFrame:
    """AGG-16, JN-11: ``connected`` distinct pairs with a path and ``without_path`` demand cells without."""
    have = paths.select("o_zone_id", "d_zone_id").distinct()
    cells = demand.join(have.withColumn("_p", F.lit(1)), ["o_zone_id", "d_zone_id"], "left")
    return cells.agg(F.count_distinct(F.when(F.col("_p").isNotNull(), F.struct("o_zone_id", "d_zone_id"))).alias("connected"), F.count(F.when(F.col("_p").isNull(), 1)).alias("without_path"))


def mean_speed(profiles: DataFrame, minutes: int) -> DataFrame:
    """AGG-17: mean of speeds of 1 or more over buckets of that many minutes."""
    rows = profiles.withColumn("bucket", F.floor(F.col("slot") * 5 / minutes).cast("long")).withColumn("_ok", F.col("speed") >= 1)
    return rows.groupBy("link_id", "bucket").agg((F.sum(F.when(F.col("_ok"), F.col("speed")).otherwise(0.0)) / F.greatest(F.lit(1), F.count(F.when(F.col("_ok"), 1)))).alias("speed"), F.first("cutoff").alias("cutoff"))


def bounding_box(nodes: DataFrame) -> DataFrame:
    """AGG-19."""
    return nodes.agg(F.min("x_coord").alias("x0"), F.max("x_coord").alias("x1"), F.min("y_coord").alias("y0"), F.max("y_coord").alias("y1"))


def meso_links(visits: DataFrame) -> DataFrame:
    """AGG-24: distinct vehicles per link."""
    return visits.groupBy("link_id").agg(F.count_distinct("agent_id").alias("agents"), F.count("*").alias("visits"))


def worst_links(visits: DataFrame, wait: str) -> DataFrame:
    """AGG-25: the link of the longest wait of each vehicle, waits of 0.001 or more; ties to the smaller link."""
    return visits.where(F.col(wait) >= 0.001).groupBy("agent_id").agg(F.max(F.struct(F.col(wait).alias("w"), (-F.col("link_id")).alias("l"))).alias("b")).select("agent_id", (-F.col("b.l")).alias("link_id"), F.col("b.w").alias("wait"))


def waiting(visits: DataFrame, wait: str) -> DataFrame:
    """AGG-26: waiting by link and minute of arrival."""
    return visits.groupBy("link_id", F.floor("t_in").alias("minute")).agg(F.sum(wait).alias("wait"), F.count("*").alias("n"))


def cumulative(visits: DataFrame, lag: int = 1) -> DataFrame:
    """WIN-02, 03: per link and minute with an event: cumulative arrivals and departures, queue, and inflow over the last ``lag`` rows."""
    a = visits.select("link_id", F.col("t_in").alias("minute"), F.lit(1).alias("a"), F.lit(0).alias("d"))
    d = visits.select("link_id", F.col("t_out").alias("minute"), F.lit(0).alias("a"), F.lit(1).alias("d"))
    per = a.unionByName(d).groupBy("link_id", "minute").agg(F.sum("a").alias("a"), F.sum("d").alias("d"))
    w = W.partitionBy("link_id").orderBy("minute")
    run = w.rowsBetween(W.unboundedPreceding, 0)
    rows = per.select("link_id", "minute", F.sum("a").over(run).alias("ca"), F.sum("d").over(run).alias("cd"))
    return rows.withColumn("queue", F.col("ca") - F.col("cd")).withColumn("inflow", F.col("ca") - F.coalesce(F.lag("ca", lag).over(w), F.lit(0)))


def run_lengths(states: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """WIN-05: runs of equal state: ``key, start, duration, state``."""
    w = W.partitionBy(key).orderBy(order)
    change = F.when(F.lag(state).over(w).eqNullSafe(F.col(state)), 0).otherwise(1)
    rows = states.withColumn("_c", change).withColumn("_run", F.sum("_c").over(w))
    return rows.groupBy(key, "_run").agg(F.min(order).alias("start"), F.count("*").alias("duration"), F.first(state).alias("state")).drop("_run")


def path_clock(path_links: DataFrame, links: DataFrame, cost: str) -> DataFrame:
    """WIN-06, 09, 10: elapsed time along each path and the link's own share."""
    rows = path_links.join(links.select("link_id", F.col(cost).alias("minutes")), "link_id")
    w = W.partitionBy("path_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("elapsed", F.sum("minutes").over(w))


def period_queue(volumes: DataFrame, key: str, order: str) -> DataFrame:
    """WIN-07: point queue over periods, q = max(0, q before + arrivals - capacity), as running sum minus its running minimum."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    rows = volumes.withColumn("_s", F.sum(F.col("arrivals") - F.col("capacity")).over(w))
    rows = rows.withColumn("queue", F.col("_s") - F.least(F.lit(0.0), F.min("_s").over(w)))
    return rows.withColumn("wait", F.try_divide(F.col("queue"), F.col("capacity"))).drop("_s")


def top_od(demand: DataFrame, n: int) -> DataFrame:
    """SRT-01: the n largest cells, ties by zones and type."""
    cells = demand.orderBy(F.desc(F.round("volume", 6)), "o_zone_id", "d_zone_id", "agent_type").limit(n)
    return cells.withColumn("rank", F.row_number().over(W.orderBy(F.desc(F.round("volume", 6)), "o_zone_id", "d_zone_id", "agent_type")))


def before_after(before: DataFrame, after: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """JN-12, SC-06: measures of both cases and their difference; what is missing in one counts as 0."""
    a = before.select(key, *[F.col(m).alias(f"{m}_before") for m in measures])
    b = after.select(key, *[F.col(m).alias(f"{m}_after") for m in measures])
    rows = a.join(b, key, "full").fillna(0.0)
    return rows.withColumns({f"{m}_diff": F.col(f"{m}_after") - F.col(f"{m}_before") for m in measures})


def deltas(series: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """WIN-04: change of a value from one iteration to the next, from 0 at first."""
    w = W.partitionBy(key).orderBy(order)
    return series.withColumn("delta", F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0.0)))


def reference_error(performance: DataFrame) -> DataFrame:
    """AGG-13: ``n, mape`` of volume and preload against the reference volumes above 1; ``performance`` has ``volume, preload, ref_link_volume``."""
    rows = performance.where(F.col("ref_link_volume") > 1)
    off = F.abs(F.col("volume") + F.col("preload") - F.col("ref_link_volume")) / F.col("ref_link_volume") * 100
    return rows.agg(F.count("*").alias("n"), F.avg(off).alias("mape"))


def vehicle_groups(paths: DataFrame) -> DataFrame:
    """AGG-15: ``agent_type, vehicles, impacted, diverted, kept, avg_minutes``: vehicles (volumes rounded to the nearest), those whose path is impacted, and of these those that were diverted or not; ``paths`` has ``volume, impacted, diverted, path_cost``."""
    v = F.floor(F.col("volume") + 0.5).cast("long")
    hit, gone = F.col("impacted") == 1, F.col("diverted") == 1
    some = lambda c: F.sum(F.when(c, v).otherwise(F.lit(0)))
    agg = paths.groupBy("agent_type").agg(F.sum(v).alias("vehicles"), some(hit).alias("impacted"), some(hit & gone).alias("diverted"), some(hit & ~gone).alias("kept"), F.sum(v * F.col("path_cost")).alias("_t"))
    return agg.withColumn("avg_minutes", F.try_divide("_t", "vehicles")).drop("_t")


def virtual_arrivals(visits: DataFrame, offsets: DataFrame) -> DataFrame:
    """WIN-08: ``link_id, minute, va, cd, queue`` at every minute with a departure or a virtual arrival.

    A vehicle arrives virtually when its free-flow time on the link is over; ``offsets``
    has ``link_id, offset`` (minutes).  Shifted arrivals and departures are counted in one
    running sum, so no ranges are joined.
    """
    rows = visits.join(broadcast_within(offsets, 16), "link_id")
    a = rows.select("link_id", (F.col("t_in") + F.col("offset")).alias("minute"), F.lit(1).alias("a"), F.lit(0).alias("d"))
    d = rows.select("link_id", F.col("t_out").alias("minute"), F.lit(0).alias("a"), F.lit(1).alias("d"))
    per = a.unionByName(d).groupBy("link_id", "minute").agg(F.sum("a").alias("a"), F.sum("d").alias("d"))
    run = W.partitionBy("link_id").orderBy("minute").rowsBetween(W.unboundedPreceding, 0)
    out = per.select("link_id", "minute", F.sum("a").over(run).alias("va"), F.sum("d").over(run).alias("cd"))
    return out.withColumn("queue", F.col("va") - F.col("cd"))


def trace(visits: DataFrame, free: DataFrame, order: str = "event_id") -> DataFrame:
    """WIN-09, SNK-09: ``agent_id, pos, link_id, t_in, elapsed, on_link, wait`` of each link a vehicle visits; ``free`` has ``link_id, fftt``."""
    w = W.partitionBy("agent_id").orderBy("t_in", order)
    rows = visits.join(broadcast_within(free, 16), "link_id")
    at = F.row_number().over(w) - 1
    begun = F.min("t_in").over(W.partitionBy("agent_id"))
    on = (F.col("t_out") - F.col("t_in")).cast("double")
    return rows.select("agent_id", at.alias("pos"), "link_id", "t_in", (F.col("t_in") - begun).alias("elapsed"), on.alias("on_link"), F.greatest(F.lit(0.0), on - F.col("fftt")).alias("wait"))


def ranked_by_time(rows: DataFrame, time: str, *ties: str) -> DataFrame:
    """SRT-04: add ``rank`` over all rows by time, then ``ties``, by :func:`ranges.numbered`, so no task orders them all."""
    return ranges.numbered(rows, [], time, *ties)
