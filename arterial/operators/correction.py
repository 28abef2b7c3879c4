"""Correction of path volumes against counts (OD-01..06, AGG-11, SRC-20)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from . import assign, classes
from . import paths as P

#: OD-06: fixed values: column updates and correction steps of a run with counts.
COLUMN_UPDATES, STEPS = 5, 100


def deviations(loads: DataFrame, counts: DataFrame) -> DataFrame:
    """OD-01: ``link_id, deviation`` of load (and preload) against counts of 1 or more; upper bounds only where exceeded."""
    preload = F.col("preload") if "preload" in loads.columns else F.lit(0.0)
    rows = counts.where("obs_count >= 1").join(loads, "link_id").withColumn("deviation", F.col("volume") + preload - F.col("obs_count"))
    return rows.where((F.col("upper_bound_flag") == 0) | (F.col("deviation") > 0)).select("link_id", "deviation")


def update_step(paths: DataFrame, deviation: DataFrame, rate: float = 0.05, most: float = 0.1) -> DataFrame:
    """OD-02, 03: ``gradient`` of each path and its new volume: down by the rate times the gradient, within a tenth of the volume, 1 at least."""
    rows = paths.withColumn("path_id", P.path_key("links")) if "path_id" not in paths.columns else paths
    keys = ["o_zone_id", "d_zone_id", "agent_type", "path_id"]
    sums = rows.select(*keys, F.explode("links").alias("link_id")).join(deviation, "link_id").groupBy(*keys).agg(F.sum("deviation").alias("gradient"))
    rows = rows.drop("gradient").join(sums, keys, "left").fillna(0.0, ["gradient"])
    v = F.col("volume")
    change = F.greatest(-v * most, F.least(v * most, F.col("gradient") * rate))
    return rows.withColumn("new_volume", F.when(F.col("gradient") == 0, v).otherwise(F.greatest(F.lit(1.0), v - change)))


def correct(paths: DataFrame, links: DataFrame, counts: DataFrame, minutes: Callable[[DataFrame], DataFrame], steps: int = STEPS) -> tuple[DataFrame, DataFrame]:
    """OD-01..05: repeat load, deviation and update; stops from step 5 on when the mean error rises by over 0.01.  Returns paths and the trace (``step, mape``)."""
    trace, last = [], None
    for step in range(steps):
        loads = settle(assign.link_volumes(paths))
        off = deviations(loads, counts)
        error = off.join(counts, "link_id").agg(F.avg(F.abs("deviation") / F.col("obs_count")) * 100).first()[0] or 0.0
        trace.append((step, float(error)))
        if step >= 5 and last is not None and error - last > 0.01:
            break
        last = error
        paths = settle(update_step(paths, off).withColumn("volume", F.col("new_volume")).drop("new_volume"))
    return paths, paths.sparkSession.createDataFrame(trace, "step int, mape double")


#: Steps after which the replayed volumes are written.
REPLAYED = 25


def _stepped(volume: np.ndarray, rows: np.ndarray, hits: np.ndarray, history: np.ndarray, rate: float, most: float) -> np.ndarray:
    """OD-02, 03: volumes after the steps of ``history``, one row of deviations by counted link for each; ``rows`` and ``hits`` pair columns with the counted links on them."""
    for off in history:
        gradient = np.bincount(rows, weights=off[hits], minlength=len(volume))
        change = np.clip(gradient * rate, -volume * most, volume * most)
        volume = np.where(gradient == 0, volume, np.maximum(1.0, volume - change))
    return volume


def correct_columns(
    columns: DataFrame, links: DataFrame, counts: DataFrame, types: list[classes.AgentType], steps: int = STEPS, rate: float = 0.05, most: float = 0.1,
) -> tuple[DataFrame, DataFrame]:
    """OD-01..06 over the columns of :func:`classes.assign`: the corrected columns and the trace (``step, mape``).

    ``counts``: ``demand_period, link_id, obs_count, upper_bound_flag``.  The counted links
    on each generated column are found once.  A step's volumes follow from those deviations
    of earlier steps alone, so a task replays them in arrays and hands on its part of the
    counted links' loads; columns are written every REPLAYED steps only.  Fixed and spliced
    columns keep their volume and count as a load.  What is broadcast grows with the counts
    (24 bytes each) and the steps since the last writing, and is checked against
    paths.NETWORK_BYTES.
    """
    spark = columns.sparkSession
    seen = counts.where("obs_count >= 1").groupBy("demand_period", "link_id").agg(F.min_by(F.struct("obs_count", "upper_bound_flag"), F.struct("upper_bound_flag", -F.col("obs_count"))).alias("c"))
    preload = links.select("demand_period", "link_id", (F.coalesce("preload", F.lit(0.0)) if "preload" in links.columns else F.lit(0.0)).alias("preload"))
    seen = settle(seen.join(preload, ["demand_period", "link_id"]).select("demand_period", "link_id", "c.obs_count", "c.upper_bound_flag", "preload"))
    if (24 + 8 * REPLAYED) * seen.count() > P.NETWORK_BYTES:
        raise ValueError("more counts than the correction can broadcast")
    frame = seen.orderBy("demand_period", "link_id").toPandas()
    place = {k: i for i, k in enumerate(zip(frame["demand_period"], frame["link_id"]))}
    obs, bound, before = (frame[c].to_numpy(dtype=float) for c in ("obs_count", "upper_bound_flag", "preload"))
    shared = spark.sparkContext.broadcast(place)

    @F.pandas_udf("array<int>")
    def counted(period: pd.Series, way: pd.Series) -> pd.Series:
        known = shared.value
        return pd.Series([[known[p, x] for x in w if (p, x) in known] for p, w in zip(period, way)], dtype=object)

    rows = columns.withColumn("hits", counted("demand_period", "links")).withColumn("pce", classes._by_type(types, "pce"))
    free = F.col("state") == classes.GENERATED
    held = rows.where(~free).select(F.explode("hits").alias("at"), (F.col("volume") * F.col("pce")).alias("v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
    base = before.copy()
    for at, v in held:
        base[at] += v
    moving = settle(rows.where(free))

    def replayed(history: np.ndarray, totals: bool) -> DataFrame:
        sent = spark.sparkContext.broadcast(history)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(obs))
            for batch in batches:
                lists = batch.column("hits")
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                hits = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                at = np.repeat(np.arange(len(sizes)), sizes)
                volume = _stepped(batch.column("volume").to_numpy(zero_copy_only=False), at, hits, sent.value, rate, most)
                if totals:
                    total += np.bincount(hits, weights=(volume * batch.column("pce").to_numpy(zero_copy_only=False))[at], minlength=len(obs))
                else:
                    yield batch.set_column(batch.schema.get_field_index("volume"), "volume", pa.array(volume))
            if totals:
                some = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["at", "v"])

        if totals:
            return moving.select("volume", "pce", "hits").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v"))
        return moving.mapInArrow(run, moving.schema)

    trace, last, history = [], None, np.zeros((0, len(obs)))
    for step in range(steps):
        load = base.copy()
        for at, v in replayed(history, True).collect():
            load[at] += v
        off = load - obs
        used = (bound == 0) | (off > 0)
        error = float(np.mean(np.abs(off[used]) / obs[used]) * 100) if used.any() else 0.0
        trace.append((step, error))
        if step >= 5 and last is not None and error - last > 0.01:
            break
        last = error
        history = np.vstack((history, np.where(used, off, 0.0)))
        if len(history) == REPLAYED:
            moving, history = settle(replayed(history, False)), history[:0]
    out = replayed(history, False) if len(history) else moving
    whole = settle(out.select(*columns.columns).unionByName(rows.where(~free).select(*columns.columns)))
    return whole, spark.createDataFrame(trace, "step int, mape double")


def zone_deviations(paths: DataFrame, totals: DataFrame, zone: str) -> DataFrame:
    """AGG-12: estimated less observed production (``zone`` o_zone_id) or attraction (d_zone_id)."""
    est = paths.groupBy(zone).agg(F.sum("volume").alias("estimate"))
    return totals.join(est, zone, "left").withColumn("deviation", F.coalesce("estimate", F.lit(0.0)) - F.col("obs_count"))
