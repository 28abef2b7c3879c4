"""Volume-delay functions as staged projections (VDF-01..20).

All inputs are columns of one row per link and period.  Formulas name their inputs
by column: ``volume lanes lane_capacity period_cap free_speed cutoff fftt alpha beta
qdf q_alpha q_beta q_cd q_n q_cp q_s t2 hours``; missing parameter columns take the
defaults below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Default parameters.
DEFAULTS = {"alpha": 0.15, "beta": 4.0, "q_alpha": 0.272876961, "q_beta": 4.0, "q_cd": 0.954946463, "q_n": 1.141574427, "q_cp": 0.400089684, "q_s": 4.0}


def with_defaults(links: DataFrame, hours: float, peak_hour: float) -> DataFrame:
    """VDF-19: add parameter columns that are missing; ``qdf`` is one over the hours of the period, ``t2`` the middle of the peak."""
    more = {**DEFAULTS, "qdf": 1.0 / hours, "t2": peak_hour, "hours": hours}
    return links.withColumns({k: F.lit(v) for k, v in more.items() if k not in links.columns})


def travel_time(links: DataFrame, kind: str = "bpr") -> DataFrame:
    """VDF-01..07, 09: add ``demand doc queue_speed rtt exponent voc bpr_speed minutes wait``."""
    c = F.col
    demand = F.greatest(F.lit(0.0), c("volume")) * c("qdf") / F.greatest(F.lit(1e-6), c("lanes"))
    rows = links.withColumn("demand", demand).withColumn("doc", c("demand") / F.greatest(F.lit(1e-5), c("lane_capacity")))
    congested = c("cutoff") / (1 + c("q_alpha") * F.pow("doc", c("q_beta")))
    a = (1 + c("q_alpha")) * c("free_speed") / F.greatest(F.lit(1e-4), c("cutoff")) - 1
    light = c("doc") < 1
    rows = rows.withColumns({
        "queue_speed": F.when(light, c("free_speed") / (1 + a * F.pow("doc", c("beta")))).otherwise(congested),
        "rtt": F.when(light, 1 / F.greatest(F.lit(0.01), c("free_speed"))).otherwise(1 / c("cutoff")),
        "exponent": F.when(light, c("beta")).otherwise(c("q_n")),
        "voc": c("volume") / F.greatest(F.lit(1e-5), c("period_cap")),
    })
    rows = rows.withColumn("bpr_speed", c("free_speed") / (1 + c("alpha") * F.pow("voc", c("beta"))))
    speed = c("bpr_speed") if kind == "bpr" else c("queue_speed")
    rows = rows.withColumn("minutes", c("fftt") * c("free_speed") / F.greatest(F.lit(0.1), speed))
    return rows.withColumn("wait", c("minutes") - c("fftt"))


def signal_delay(links: DataFrame, cycle: str, red: str, saturation: str) -> DataFrame:
    """VDF-08: where a cycle is given, uniform signal delay replaces the congestion time."""
    late = F.pow(F.col(red), 2) / (2 * F.greatest(F.lit(1.0), F.col(cycle))) / 60.0
    minutes = late / F.greatest(1 - F.col("demand") / F.col(saturation), F.lit(0.1)) + F.col("fftt")
    rows = links.withColumn("minutes", F.when(F.col(cycle) >= 1, minutes).otherwise(F.col("minutes")))
    return rows.withColumn("wait", F.col("minutes") - F.col("fftt"))


def queue_shape(links: DataFrame) -> DataFrame:
    """VDF-10..15: add ``p vt2 t0 t3 mu gamma``; without a queue (p of 0) mu and gamma are null."""
    c = F.col
    rows = links.withColumn("p", c("q_cd") * F.pow("doc", c("exponent")))
    rows = rows.withColumn("vt2", c("cutoff") / F.greatest(F.lit(0.001), c("q_cp") * F.pow("p", c("q_s")) + 1))
    rows = rows.withColumns({"t0": c("t2") - c("p") / 2, "t3": c("t2") + c("p") / 2})
    rows = rows.withColumn("mu", F.when(c("p") > 0, F.least("lane_capacity", F.try_divide(c("demand"), c("p")))))
    return rows.withColumn("gamma", F.when(c("p") > 0, (1 / c("vt2") - c("rtt")) * 64 * c("mu") * F.try_divide(F.lit(1.0), F.pow("p", F.lit(4.0)))))


def queue_at(t: Column) -> Column:
    """Queue length at hour t inside [t0, t3]."""
    return F.col("gamma") / 4 * F.pow(t - F.col("t0"), 2) * F.pow(t - F.col("t3"), 2)


def profile(links: DataFrame, key: str, start_hour: float, end_hour: float) -> DataFrame:
    """VDF-16: one row per 5-minute slot from start to end inclusive: ``key, slot, speed``.

    Inside the queue the speed follows the queue; before and after it moves in a
    straight line between free speed and the larger of cutoff and average speed.
    """
    slots = F.sequence(F.lit(round(start_hour * 12)), F.lit(round(end_hour * 12)))
    rows = links.withColumn("slot", F.explode(slots)).withColumn("t", F.col("slot") / 12.0)
    c = F.col
    wait = queue_at(c("t")) / F.greatest(F.lit(0.001), c("mu"))
    edge = F.greatest("cutoff", c("free_speed") * c("fftt") / F.greatest(F.lit(1e-6), c("minutes")))
    before = c("free_speed") + (edge - c("free_speed")) * F.try_divide(c("t") - start_hour, c("t0") - start_hour)
    after = edge + (c("free_speed") - edge) * F.try_divide(c("t") - c("t3"), end_hour - c("t3"))
    inside = (c("t") >= c("t0")) & (c("t") <= c("t3"))
    speed = F.when(inside & c("mu").isNotNull(), 1 / (wait + c("rtt"))).when(c("t") < c("t0"), before).otherwise(after)
    return rows.select(key, "slot", F.coalesce(speed, c("free_speed")).alias("speed"), "free_speed", "cutoff")


def severe_hours(profiles: DataFrame, key: str) -> DataFrame:
    """VDF-17: hours with a speed below half the free speed."""
    return profiles.groupBy(key).agg((F.count(F.when(F.col("speed") < F.col("free_speed") / 2, 1)) * 5.0 / 60.0).alias("severe_hours"))


def bpr_minutes(fftt: Column, volume: Column, capacity: Column, alpha: float = 0.15, beta: float = 4.0) -> Column:
    """VDF-20."""
    return fftt * (1 + alpha * F.pow(volume / F.greatest(F.lit(1e-5), capacity), F.lit(beta)))
