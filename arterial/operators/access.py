"""Zones made from nodes or planning areas, and access to stops (SRC-24, DM-03, DM-04, JN-13, JN-14, SNK-12, SNK-16)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry

#: Metres of a degree of latitude, a little less than the true value, so that cells are never too narrow.
_DEGREE = 110_000.0


def near_pairs(points: DataFrame, others: DataFrame, key: str, other: str, metres: float) -> DataFrame:
    """JN-13: ``key, other, metres`` of every pair within a distance; both have ``x_coord, y_coord``.

    Points are dealt into cells at least as wide as the distance and joined with the cells
    around.  The width in longitude follows from the largest latitude in the data; cells go
    round the globe, so pairs across the 180th meridian are found.
    """
    height = metres / _DEGREE
    far = points.select("y_coord").unionByName(others.select("y_coord")).agg(F.coalesce(F.max(F.abs("y_coord")), F.lit(0.0))).first()[0]
    narrow = math.cos(math.radians(min(90.0, far + height)))
    width = height / narrow if narrow > 1e-9 else 360.0
    columns = max(1, int(360.0 / width))
    row = lambda c: F.floor(F.col(c) / height).cast("long")
    column = lambda c: F.pmod(F.floor((F.col(c) + 180.0) / (360.0 / columns)).cast("long"), F.lit(columns))
    a = points.select(key, F.col("x_coord").alias("_x1"), F.col("y_coord").alias("_y1"), column("x_coord").alias("_cx"), row("y_coord").alias("_cy"))
    around = F.array_distinct(F.transform(F.array(*[F.lit(i) for i in (-1, 0, 1)]), lambda i: F.pmod(column("x_coord") + i, F.lit(columns))))
    b = others.select(F.col(other), F.col("x_coord").alias("_x2"), F.col("y_coord").alias("_y2"), row("y_coord").alias("_ny"), F.explode(around).alias("_cx"))
    b = b.withColumn("_cy", F.explode(F.array(*[F.col("_ny") + i for i in (-1, 0, 1)]))).drop("_ny")
    rows = a.join(b, ["_cx", "_cy"]).withColumn("metres", geometry.haversine(F.col("_x1"), F.col("_y1"), F.col("_x2"), F.col("_y2")))
    return rows.where(F.col("metres") <= metres).select(key, other, "metres")


def ranked(pairs: DataFrame, key: str, other: str, k: int) -> DataFrame:
    """SRT-03: the k nearest of each key, ties to the smaller id: ``key, other, rank, metres``."""
    order = W.partitionBy(key).orderBy(F.round("metres", 3), other)
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(key, other, "rank", "metres")


def grid_zones(nodes: DataFrame, cell: float) -> DataFrame:
    """DM-03, SNK-16: one zone for each grid cell with nodes: ``zone_id, cell_code, x_coord, y_coord`` (centre), ``access_node_vector, n_nodes``.

    Zones are numbered column by column from the south-west corner of the nodes' box, a
    closed form, so that no task orders all cells.
    """
    cx, cy = geometry.cell_of(F.col("x_coord"), F.col("y_coord"), cell)
    rows = nodes.select("node_id", cx.alias("cx"), cy.alias("cy"))
    cells = rows.groupBy("cx", "cy").agg(F.count("*").alias("n_nodes"), F.array_join(F.transform(F.sort_array(F.collect_list("node_id")), lambda x: x.cast("string")), ";").alias("access_node_vector"))
    box = cells.agg(F.min("cx").alias("x0"), F.min("cy").alias("y0"), F.max("cy").alias("y1"))
    at = cells.crossJoin(F.broadcast(box))
    number = (F.col("cx") - F.col("x0")) * (F.col("y1") - F.col("y0") + 1) + F.col("cy") - F.col("y0") + 1
    return at.select(number.cast("long").alias("zone_id"), geometry.cell_code(F.col("cx"), F.col("cy"), F.col("x0"), F.col("y0")).alias("cell_code"), ((F.col("cx") + 0.5) * cell).alias("x_coord"), ((F.col("cy") + 0.5) * cell).alias("y_coord"), "access_node_vector", "n_nodes")


def taz_access(areas: DataFrame, nodes: DataFrame, k: int = 4, metres: float = 2000.0) -> DataFrame:
    """DM-04: ``zone_id, node_id, rank, metres``: the k nearest boundary nodes within the distance, or, where an area has none, the k nearest nodes."""
    pairs = near_pairs(areas, nodes, "zone_id", "node_id", metres).join(nodes.select("node_id", (F.coalesce("is_boundary", F.lit(0)) != 0).alias("_b")), "node_id")
    edge = pairs.where("_b")
    rest = pairs.join(edge.select("zone_id").distinct(), "zone_id", "left_anti")
    return ranked(edge.unionByName(rest), "zone_id", "node_id", k)


def activity_stops(activities: DataFrame, stops: DataFrame, lower: float, upper: float, k: int) -> DataFrame:
    """JN-14: ``node_id, stop_id, rank, metres, within``: the k nearest stops of each activity node between two distances; where it has none, its nearest stop below the upper one."""
    pairs = near_pairs(activities, stops, "node_id", "stop_id", upper)
    band = ranked(pairs.where(F.col("metres") >= lower), "node_id", "stop_id", k).withColumn("within", F.lit(True))
    rest = pairs.where(F.col("metres") < upper).join(band.select("node_id").distinct(), "node_id", "left_anti")
    return band.unionByName(ranked(rest, "node_id", "stop_id", 1).withColumn("within", F.lit(False)))


def access_links(access: DataFrame, from_col: str, to_col: str) -> DataFrame:
    """SNK-12: connectors both ways, link type 1000: ``from_node_id, to_node_id, length_m, link_type``."""
    rows = access.select(F.col(from_col).alias("from_node_id"), F.col(to_col).alias("to_node_id"), F.col("metres").alias("length_m"))
    back = rows.select(F.col("to_node_id").alias("from_node_id"), F.col("from_node_id").alias("to_node_id"), "length_m")
    return rows.unionByName(back).withColumn("link_type", F.lit(1000))
