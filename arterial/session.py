"""Session and checkpoint helpers."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings a session needs; the number of shuffle partitions and memory belong to the cluster.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "arterial", **more: str) -> SparkSession:
    """The running session, or a new one with the settings above."""
    return SparkSession.builder.appName(name).config(map=SETTINGS | more).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the context's checkpoint folder, else that of the session's ``spark.checkpoint.dir``.

    Where neither is set, a local session (tests) makes its own; on a cluster there is no
    place then that outlives an executor, and an error says so.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and re.match(r"local(\[.*)?$", context.master):
            folder = tempfile.mkdtemp(prefix="spark-checkpoints-")
        if not folder:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes up to which a side of a join is broadcast.
BROADCAST_BYTES = 32 << 20


def broadcast_within(df: DataFrame, row_bytes: int, more: Column | None = None) -> DataFrame:
    """``df``, marked for broadcast if it has at most BROADCAST_BYTES: ``row_bytes`` a row and ``more``, a column of bytes; beyond, Spark joins it its own way.

    ``df`` is read once to size it, so it should be settled or cheap.
    """
    n, extra = df.agg(F.count("*"), F.sum(more) if more is not None else F.lit(0)).first()
    return F.broadcast(df) if n * row_bytes + (extra or 0) <= BROADCAST_BYTES else df
