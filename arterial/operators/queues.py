"""Vehicle queues in discrete time (SIM-02..06, 08, 13..15, AGG-18, 22, JN-19, 20, FLT-11).

A link is a point queue with a closed form: a window over its arrivals, or slices of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import BROADCAST_BYTES, settle
from . import ranges

#: Arrivals of one link up to which a window orders them.
WINDOW_ROWS = 1_000_000


def single_link(arrivals: DataFrame, link: str, agent: str, ready: str, headway: str) -> DataFrame:
    """SIM-06, 08, 14, 15: first in, first out: departure i is the later of its ready time and departure i-1 plus the headway, one for each link.

    Closed form: i * h + running maximum of (ready_i - i * h).  Where a link has more than
    WINDOW_ROWS arrivals the time lines are cut into slices: a slice is summed up by its
    number of arrivals and its greatest slack, these are combined over the slices before,
    and each slice then runs alone.
    """
    busiest = arrivals.groupBy(link).count().agg(F.max("count")).first()[0] or 0
    if busiest > WINDOW_ROWS:
        return _sliced(arrivals, link, agent, ready, headway)
    w = W.partitionBy(link).orderBy(ready, agent)
    rows = arrivals.withColumn("_i", F.row_number().over(w) - 1)
    slack = F.max(F.col(ready) - F.col("_i") * F.col(headway)).over(w.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("depart", F.col("_i") * F.col(headway) + slack)
    return rows.withColumn("wait", F.col("depart") - F.col(ready)).drop("_i")


def _sliced(arrivals: DataFrame, link: str, agent: str, ready: str, headway: str) -> DataFrame:
    rows = ranges.placed(arrivals, [link], ready, agent)
    counted = ranges.joined(rows, ranges.parts(rows, [link]), [link])
    # a row's number on its link follows from its place, so slack needs no order
    rows = settle(counted.withColumn("_i", F.col("_before") + F.col("_at") - F.col("_first")).withColumn("_slack", F.col(ready) - F.col("_i") * F.col(headway)).drop("_before", "_first", "_n"))
    most = rows.groupBy(link, "_part").agg(F.max("_slack").alias("_most"))
    carried = F.max("_most").over(W.partitionBy(link).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    sums = settle(most.withColumn("_carry", carried).drop("_most"))
    both = ranges.joined(rows, sums, [link])
    own = F.max("_slack").over(W.partitionBy(link, "_part").orderBy("_at").rowsBetween(W.unboundedPreceding, 0))
    out = both.withColumn("depart", F.col("_i") * F.col(headway) + F.greatest(own, F.col("_carry")))
    return out.withColumn("wait", F.col("depart") - F.col(ready)).select(*arrivals.columns, "depart", "wait")


def varying_link(arrivals: DataFrame, capacity: DataFrame, link: str, agent: str, ready: str) -> DataFrame:
    """SIM-02, 06, SC-08: the same queue where a link's capacity changes from minute to minute.

    ``capacity``: link, ``minute, capacity`` (vehicles a minute) for minutes from 0 on
    without gaps; the last minute's capacity goes on.  Time is counted in vehicles that
    could have passed by then: on that clock every vehicle takes one unit, so the closed
    form of :func:`single_link` holds, and departures are read back from it.  Adds
    ``depart, wait``; vehicles of a link without capacity never depart (null).  A link's
    minutes are its horizon, which does not grow with the arrivals.
    """
    c = capacity.groupBy(F.col(link).alias("_l"), "minute").agg(F.max("capacity").cast("double").alias("_c"))
    upto = lambda i: F.coalesce(F.sum("_c").over(W.partitionBy("_l").orderBy("minute").rowsBetween(W.unboundedPreceding, i)), F.lit(0.0))
    last = F.max("minute").over(W.partitionBy("_l"))
    # a step begins exactly where the one before ends
    steps = settle(c.withColumns({"_begin": upto(-1), "_end": upto(0), "_last": F.col("minute") == last}))
    tail = F.broadcast if steps.count() * 40 <= BROADCAST_BYTES else lambda df: df
    ends = steps.where("_last").select("_l", F.col("minute").alias("_stop"))
    at = arrivals.join(tail(ends), F.col(link) == F.col("_l"), "left").drop("_l")
    at = at.withColumn("_minute", F.least(F.floor(ready).cast("long"), F.col("_stop").cast("long")))
    at = at.join(tail(steps.select("_l", F.col("minute").alias("_m"), "_begin", "_c")), (F.col(link) == F.col("_l")) & (F.col("_minute") == F.col("_m")), "left")
    clock = at.withColumns({"_units": F.col("_begin") + (F.col(ready) - F.col("_minute")) * F.col("_c"), "_one": F.lit(1.0)})
    clock = clock.select(*arrivals.columns, "_units", "_one")
    queued = single_link(clock.where("_units is not null"), link, agent, "_units", "_one").drop("wait", "_units", "_one").withColumnRenamed("depart", "_out")
    # the step that holds a departure: both sides meet in whole units
    unit = F.explode(F.sequence(F.floor("_begin"), F.when(F.col("_last"), F.floor("_begin")).otherwise(F.floor("_end"))))
    slots = steps.where("_c > 0").select("_l", "minute", "_begin", "_end", "_c", "_last", unit.alias("_unit"))
    reach = settle(steps.where("_c > 0").groupBy("_l").agg(F.max(F.when(F.col("_last"), F.floor("_begin"))).alias("_open")))
    due = queued.join(tail(reach), F.col(link) == F.col("_l"), "left").drop("_l")
    due = due.withColumn("_unit", F.least(F.floor("_out"), F.coalesce("_open", F.floor("_out"))))
    inside = (F.col("_out") >= F.col("_begin")) & ((F.col("_out") < F.col("_end")) | F.col("_last"))
    found = due.withColumnRenamed("_unit", "_u").join(slots, (F.col(link) == F.col("_l")) & (F.col("_u") == F.col("_unit")) & inside, "left")
    depart = F.col("minute") + (F.col("_out") - F.col("_begin")) / F.col("_c")
    out = found.withColumns({"depart": depart, "wait": depart - F.col(ready)}).select(*arrivals.columns, "depart", "wait")
    idle = clock.where("_units is null").select(*arrivals.columns, F.lit(None).cast("double").alias("depart"), F.lit(None).cast("double").alias("wait"))
    return out.unionByName(idle)


def signal_seconds(signals: DataFrame, seconds: int) -> DataFrame:
    """SIM-03, JN-20: ``link_id, second, state, capacity``: green inside [start, end) of the cycle; in green the lanes pass on even seconds, none on odd."""
    rows = signals.withColumn("second", F.explode(F.sequence(F.lit(0), F.lit(seconds - 1))))
    at = F.pmod(F.col("second"), F.col("cycle"))
    green = (at >= F.col("start_green")) & (at < F.col("end_green"))
    capacity = F.when(green & (F.col("second") % 2 == 0), F.col("lanes")).otherwise(0.0)
    return rows.select("link_id", "second", F.when(green, 1).otherwise(0).alias("state"), capacity.alias("capacity"))


def stochastic_capacity(links: DataFrame, steps: int, seed: int = 101, an_hour: int = 3600) -> DataFrame:
    """SIM-02: ``link_id, step, capacity``: whole vehicles in each of ``steps`` steps, of which ``an_hour`` are an hour, whose mean is the hourly capacity: the fraction is rounded up with its own probability.

    The draw is a hash of link, step and seed, so any step can be drawn alone.
    """
    rows = links.select("link_id", "lane_capacity", "lanes").withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    per = F.col("lane_capacity") * F.col("lanes") / float(an_hour)
    text = F.concat_ws(";", F.col("link_id").cast("string"), F.col("step").cast("string"), F.lit(str(seed)))
    u = F.conv(F.substring(F.md5(text.cast("binary")), 1, 10), 16, 10).cast("double") / float(1 << 40)
    return rows.select("link_id", "step", (F.floor(per) + (u < per - F.floor(per)).cast("int")).alias("capacity"))


def path_times(visits: DataFrame, agents: DataFrame) -> DataFrame:
    """AGG-18, JN-19: mean simulated minutes per path with more than one vehicle."""
    per = visits.groupBy("agent_id").agg((F.max("t_out") - F.min("t_in")).alias("minutes"))
    return agents.join(per, "agent_id").groupBy("path_id").agg(F.count("*").alias("n"), F.avg("minutes").alias("minutes")).where("n > 1")


def network_counters(visits: DataFrame, every: int = 10) -> DataFrame:
    """SIM-13: entries, exits and mean minutes on a link by bucket of ``every`` minutes."""
    return visits.groupBy((F.floor(F.col("t_in") / every) * every).alias("minute")).agg(F.count("*").alias("entries"), F.avg(F.col("t_out") - F.col("t_in")).alias("minutes"))


def sampled(rows: DataFrame, order: list[str], every: int = 1, most: int | None = None, only: Column | None = None) -> DataFrame:
    """FLT-11: the first of every ``every`` rows in ``order``, of those where ``only`` holds, ``most`` of them at most.

    ``order`` should tell rows apart; rows are numbered by :func:`ranges.numbered`, so no task orders them all.
    """
    kept = rows if only is None else rows.where(F.coalesce(only, F.lit(False)))
    at = ranges.numbered(kept, [], *order, name="_nth")
    chosen = at.where((F.col("_nth") - 1) % every == 0)
    return (chosen if most is None else chosen.where(F.col("_nth") <= most * every)).drop("_nth")
