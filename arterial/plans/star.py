"""A deterministic road network and its demand, derived from the star-schema tables.

Nations are the nodes and zones of a 5 x 5 grid; order lines between the customer's
and the supplier's nation are trips; ``events`` give counts, profiles and vehicle
movements.  The dimension tables here have a fixed number of rows (25 nodes, 80
links), so they may be broadcast; facts are aggregated before any join with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock, units

TOTAL_TRIPS = 30_000.0
#: (period, first hour, last hour, hours)
PERIODS = (("am", 6, 10, 4.0), ("md", 10, 15, 5.0), ("pm", 15, 19, 4.0))
#: A rectangle over the middle of the grid, used as subarea.
SUBAREA = [(-111.985, 33.415), (-111.935, 33.415), (-111.935, 33.465), (-111.985, 33.465)]

#: A rectangle whose corners no line between two nodes meets.
FOCUS = [(-111.9857, 33.4143), (-111.9341, 33.4143), (-111.9341, 33.4657), (-111.9857, 33.4657)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    n = table(spark, sf_dir, "nation")
    return n.select((k + 1).alias("node_id"), (k + 1).alias("zone_id"), F.col("n_regionkey").alias("district_id"), (F.lit(-112.0) + F.lit(0.02) * (k % 5)).alias("x_coord"), (F.lit(33.40) + F.lit(0.02) * F.floor(k / 5)).alias("y_coord"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both directions between grid neighbours, numbered by (from, to); attributes are closed forms of the number."""
    k = F.col("n_nationkey")
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, -1), (-1, 0), (1, 0), (0, 1))])
    ends = table(spark, sf_dir, "nation").select((k % 5).alias("cx"), F.floor(k / 5).cast("int").alias("cy"), F.explode(steps).alias("s"))
    tx, ty = F.col("cx") + F.col("s.dx"), F.col("cy") + F.col("s.dy")
    pairs = ends.where(tx.between(0, 4) & ty.between(0, 4)).select((F.col("cy") * 5 + F.col("cx") + 1).alias("from_node_id"), (ty * 5 + tx + 1).alias("to_node_id"))
    # the number of a link counts the grid links before it: a closed form would hide the rule, and 80 rows order cheaply
    from pyspark.sql import Window as W

    i = F.col("link_id")
    rows = pairs.withColumn("link_id", F.row_number().over(W.orderBy("from_node_id", "to_node_id")))
    return rows.select(
        "link_id", "from_node_id", "to_node_id",
        (F.lit(1609.0) * (1 + (7 * i) % 5)).alias("length_m"),
        (1 + i % 3).cast("double").alias("lanes"),
        (30 + 10 * (i % 4)).cast("double").alias("free_speed"),
        (900 + 150 * (i % 5)).cast("double").alias("lane_capacity"),
        (1 + i % 3).alias("link_type"),
        F.when(i % 11 == 0, "building;machinery").otherwise("").alias("allowed_uses"),
    )


def costed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with free-flow minutes, cutoff speed and the morning's capacity; ``cost`` has a tiny share of the number, so that best paths are unique."""
    c = F.col
    rows = links(spark, sf_dir)
    rows = rows.withColumns({"fftt": units.free_minutes(c("length_m"), c("free_speed")), "cutoff": units.cutoff_speed(c("free_speed")), "period_cap": units.period_capacity(c("lane_capacity"), c("lanes"), PERIODS[0][3])})
    return rows.withColumn("cost", c("fftt") + c("link_id") * 1e-6)


def od_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``o_zone_id, d_zone_id, agent_type, volume``: quantities between nations by customer segment, scaled to TOTAL_TRIPS."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    # sum quantities per (order's customer, supplier) key first: the dimension joins see far fewer rows
    per = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    cust = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") + 1).alias("o_zone_id"), F.lower("c_mktsegment").alias("agent_type"))
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") + 1).alias("d_zone_id"))
    cells = per.join(cust, F.col("o_custkey") == F.col("c_custkey")).join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
    cells = cells.where("o_zone_id <> d_zone_id").groupBy("o_zone_id", "d_zone_id", "agent_type").agg(F.sum("q").alias("q"))
    total = cells.agg(F.sum("q").alias("total"))
    return cells.join(F.broadcast(total)).select("o_zone_id", "d_zone_id", "agent_type", (F.col("q") * F.lit(TOTAL_TRIPS) / F.col("total")).alias("volume"))


def period_of(minute: Column) -> Column:
    """Period of day of a minute; null outside all periods."""
    out = F.lit(None).cast("string")
    for name, a, b, _ in PERIODS:
        out = F.when((minute >= a * 60) & (minute < b * 60), F.lit(name)).otherwise(out)
    return out


def event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, user_id, link_id, ts, minute, day`` of events; the link follows from the user."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return e.withColumns({"link_id": (F.col("user_id") % 80 + 1).cast("int"), "minute": clock.minute_of_day(F.col("ts")), "day": F.datediff("ts", F.lit("2024-01-01")).cast("long")})


def link_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``link_id, demand_period, obs_count, upper_bound_flag``."""
    e = event_times(spark, sf_dir).withColumn("demand_period", period_of(F.col("minute"))).where("demand_period is not null")
    rows = e.groupBy("link_id", "demand_period").agg(F.count("*").cast("double").alias("obs_count"))
    return rows.withColumn("upper_bound_flag", (F.col("link_id") % 7 == 0).cast("int"))


def trip_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``agent_id, link_id, t_in, t_out``: each event enters its link; the user's next event ends the stay, five minutes later at most."""
    from pyspark.sql import Window as W

    e = event_times(spark, sf_dir).withColumn("t", F.col("day") * 1440 + F.col("minute"))
    nxt = F.lead("t").over(W.partitionBy("user_id").orderBy("t", "event_id"))
    link = (F.col("event_id") % 80 + 1).cast("int")
    return e.select(F.col("user_id").alias("agent_id"), "event_id", link.alias("link_id"), F.col("t").alias("t_in"), F.least(F.coalesce(nxt, F.col("t") + 5), F.col("t") + 5).alias("t_out"))
