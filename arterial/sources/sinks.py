"""Writers and the row shapes of the output tables (SNK-01..20, FN-14, 18, FLT-01..03, 11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clock


def write_csv(df: DataFrame, path: str) -> None:
    """One folder of CSV parts with headers; rows stay in their partitions."""
    df.write.mode("overwrite").option("header", True).csv(path)


def link_rows(performance: DataFrame, period: str) -> DataFrame:
    """SNK-01: real links with volume (FLT-01, 02); a scenario code keeps a link without volume."""
    code = F.col("scenario_code") if "scenario_code" in performance.columns else F.lit(None).cast("string")
    return performance.where(F.col("link_type") != -1).where((F.col("volume") >= 0.001) | code.isNotNull()).withColumn("demand_period", F.lit(period))


def route_rows(paths: DataFrame, least_volume: float = 0.0) -> DataFrame:
    """SNK-02: one row per path with its link sequence as text (FN-18, FLT-06)."""
    rows = paths.where(F.col("volume") >= least_volume)
    return rows.select("o_zone_id", "d_zone_id", "agent_type", "volume", "path_cost", F.array_join("links", ";").alias("link_sequence"), F.size("links").alias("n_links"))


def accessibility_rows(demand: DataFrame, paths: DataFrame) -> DataFrame:
    """SNK-03, JN-11: every demand cell, with its paths or connectivity 0."""
    keys = ["o_zone_id", "d_zone_id", "agent_type"]
    have = paths.select(*keys, F.col("volume").alias("path_volume"), "path_cost")
    return demand.join(have, keys, "left").withColumn("connectivity", F.col("path_cost").isNotNull().cast("int")).fillna(0.0, ["path_volume"]).withColumn("path_cost", F.coalesce("path_cost", F.lit(-1.0)))


def wide_profile(profiles: DataFrame, key: str, slots: list[int], value: str = "speed") -> DataFrame:
    """SNK-01, 04: one column ``vHH:MM`` for each listed 5-minute slot."""
    wide = profiles.groupBy(key).pivot("slot", slots).agg(F.first(value))
    return wide.toDF(key, *[f"v{s // 12:02d}:{s % 12 * 5:02d}" for s in slots])


def queue_rows(shapes: DataFrame) -> DataFrame:
    """SNK-04, FLT-03: queue parameters of links with a volume of 1 or more."""
    return shapes.where("volume >= 1").select("link_id", "volume", "doc", "p", "t0", "t3", "vt2", "mu", "gamma")


def agent_rows(visits: DataFrame, every: int = 1) -> DataFrame:
    """SNK-07, FLT-11: one row per vehicle: departure, arrival and minutes; every n-th vehicle."""
    rows = visits.groupBy("agent_id").agg(F.min("t_in").alias("departure"), F.max("t_out").alias("arrival"), F.sum("wait").alias("wait"))
    return rows.where(F.pmod(F.col("agent_id"), F.lit(every)) == 0).withColumn("minutes", F.col("arrival") - F.col("departure")).withColumn("departure_text", clock.hhmm(F.col("departure")))


def trajectory_rows(visits: DataFrame) -> DataFrame:
    """SNK-08, 09: link and time sequences of each vehicle; a vehicle's list is as long as its trip."""
    seq = F.array_sort(F.collect_list(F.struct("t_in", "link_id", "t_out")))
    rows = visits.groupBy("agent_id").agg(seq.alias("_s"))
    return rows.select("agent_id", F.array_join(F.transform("_s", lambda x: x["link_id"].cast("string")), ";").alias("link_sequence"), F.array_join(F.transform("_s", lambda x: F.round(x["t_in"], 2).cast("string")), ";").alias("time_sequence"))


def td_rows(cumulative: DataFrame, links: DataFrame) -> DataFrame:
    """SNK-05: counts, queue and density by link and minute."""
    rows = cumulative.join(links.select("link_id", "length_m", "lanes"), "link_id")
    return rows.select("link_id", "minute", "ca", "cd", "queue", "inflow", (F.col("queue") / (F.col("length_m") / 1609.0 * F.col("lanes"))).alias("density"))


def trip_matrix(demand: DataFrame, zones: list[int]) -> DataFrame:
    """SNK-16: the demand as a square matrix."""
    return demand.groupBy("o_zone_id").pivot("d_zone_id", zones).agg(F.sum("volume"))


def measurement_rows(links: DataFrame, every: int = 10) -> DataFrame:
    """SNK-19: a default measurement table: every n-th real link, a third of its capacity."""
    rows = links.where((F.col("link_type") != -1) & (F.pmod(F.col("link_id"), F.lit(every)) == 0))
    return rows.select(F.lit("link").alias("measurement_type"), "from_node_id", "to_node_id", (F.col("period_cap") / 3).alias("count1"), F.lit(0).alias("upper_bound_flag1"))


def background_volume(paths: DataFrame, least_volume: float) -> DataFrame:
    """SNK-20, AGG-09: link volumes of minor paths."""
    from ..operators.assign import link_volumes

    return link_volumes(paths.where(F.col("volume") < least_volume)).select("link_id", F.col("volume").alias("background_volume"))


def summary(rows: list[tuple[str, int, str, float]], df: DataFrame) -> DataFrame:
    """SNK-15: a log of (stage, iteration, name, value)."""
    return df.sparkSession.createDataFrame(rows, "stage string, iteration int, name string, value double")


def model_nodes(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """SNK-12: physical nodes with their number of outgoing links."""
    out = links.groupBy(F.col("from_node_id").alias("node_id")).agg(F.count("*").alias("n_out"))
    rows = nodes.where("node_id >= 0").join(out, "node_id", "left").fillna(0, ["n_out"])
    return rows.select("node_id", "zone_id", "n_out", "x_coord", "y_coord")


def model_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """SNK-12: links with the line between their nodes as text, six digits a coordinate."""
    end = lambda side: nodes.select(F.col("node_id").alias(f"{side}_node_id"), F.format_string("%.6f %.6f", "x_coord", "y_coord").alias(f"_{side}"))
    rows = links.join(end("from"), "from_node_id").join(end("to"), "to_node_id")
    return rows.withColumn("geometry", F.concat(F.lit("LINESTRING ("), "_from", F.lit(","), "_to", F.lit(")"))).drop("_from", "_to")


def tree_rows(tree: DataFrame) -> DataFrame:
    """SNK-13: ``origin, node, pred_node, pred_link, cost`` of every label; the origin has no predecessor."""
    return tree.select("origin", "node", F.coalesce("pred_node", F.lit(-1)).alias("pred_node"), F.coalesce("pred_link", F.lit(-1)).alias("pred_link"), "cost")


def subarea_rows(zones: DataFrame) -> DataFrame:
    """SNK-17: zones that lie in the subarea or whose trips touch it, with the reason: ``zones`` has ``zone_id, inside, impact``."""
    rows = zones.where(F.col("inside") | (F.col("impact") > 0))
    return rows.select("zone_id", F.when(F.col("inside"), "inside").otherwise("related").alias("relation"), "impact")


def agent_summary(visits: DataFrame) -> DataFrame:
    """SNK-10: per vehicle: links visited, minutes from first entry to last exit."""
    return visits.groupBy("agent_id").agg(F.count("*").alias("n_links"), (F.max("t_out") - F.min("t_in")).alias("minutes"))


#: SNK-11: the layout of a trajectory record: id, origin, destination, number of links, then as many link ids and entry minutes; little-endian.
TRAJECTORY_HEAD = "<qiii"


def trajectory_records(visits: DataFrame) -> DataFrame:
    """SNK-11: ``agent_id, record``: each vehicle's trajectory as one binary record, packed in batches by a few struct calls."""
    import struct
    from collections.abc import Iterator

    import pyarrow as pa

    steps = F.array_sort(F.collect_list(F.struct("t_in", "link_id")))
    rows = visits.groupBy("agent_id").agg(steps.alias("s")).select("agent_id", F.transform("s", lambda x: x["link_id"].cast("int")).alias("links"), F.transform("s", lambda x: x["t_in"].cast("float")).alias("times"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for agent, links, times in zip(*(c.to_pylist() for c in batch.columns)):
                out.append(struct.pack(f"{TRAJECTORY_HEAD}{len(links)}i{len(times)}f", agent, links[0], links[-1], len(links), *links, *times))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["agent_id", "record"])

    return rows.mapInArrow(run, "agent_id long, record binary")
