"""Streaming forms: windowed link counts with a watermark, and link queues as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def slot_counts(events: DataFrame, ts: str = "ts", key: str = "link_id", width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events per key and tumbling window; events later than the watermark are dropped.  Works on batch and streaming input alike."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    counts = rows.groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), key, "n")


def link_queues(arrivals: DataFrame, headway: float, ts: str = "ts", key: str = "link_id", idle: str = "60 minutes") -> DataFrame:
    """Departure time of each arrival from its link's point queue, kept as state across batches: ``key, agent_id, ready, depart`` (seconds).

    Arrivals of a link must come in order of time across batches; inside a batch they
    are sorted, and departures follow by the closed form of
    :func:`arterial.operators.queues.single_link`, begun at the last departure.  A link's
    state is dropped once the watermark is ``idle`` past its last departure: later arrivals
    find it empty, as they would anyway.
    """
    rows = arrivals.withWatermark(ts, idle).select(key, "agent_id", ts, F.unix_timestamp(ts).cast("double").alias("ready"))

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else float("-inf")
        pdf = pd.concat(list(parts)).sort_values(["ready", "agent_id"])
        i = np.arange(len(pdf)) * headway
        depart = i + np.maximum(np.maximum.accumulate(pdf["ready"].to_numpy() - i), last + headway)
        state.update((float(depart[-1]),))
        state.setTimeoutTimestamp(max(int(depart[-1] * 1000), state.getCurrentWatermarkMs()) + 1)
        yield pdf.assign(depart=depart)[[key, "agent_id", "ready", "depart"]]

    kind = arrivals.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, agent_id long, ready double, depart double", "last double", "append", GroupStateTimeout.EventTimeTimeout)
