"""A stream gives the batch's rows; late rows are dropped; state carries over batches."""

import datetime as dt

from pyspark.sql import functions as F

from arterial.operators import queues
from arterial.streaming import slots

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "ts timestamp, agent_id long, link_id int"


def feed(spark, folder, batches, query):
    """Write one file per batch and run the stream over each; all rows that came out."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(folder / "in"))
        run = query(stream).writeStream.format("parquet").outputMode("append").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start()
        run.awaitTermination(120)
        assert not run.exception()
    return spark.read.parquet(str(folder / "out"))


def test_windows(spark, tmp_path):
    at = lambda m: DAY + dt.timedelta(minutes=m)
    batches = [[(at(0), 1, 1), (at(1), 2, 1), (at(7), 3, 2)], [(at(30), 4, 1)], [(at(2), 5, 1), (at(60), 6, 1)], [(at(200), 7, 1)]]
    got = {(r["window_start"], r["link_id"]): r["n"] for r in feed(spark, tmp_path, batches, slots.slot_counts).collect()}
    kept = [r for b in batches for r in b if r[1] != 5]  # two minutes past midnight comes too late
    want = {(r["window_start"], r["link_id"]): r["n"] for r in slots.slot_counts(spark.createDataFrame(kept, SCHEMA)).collect() if r["window_start"] < at(185)}
    assert got == want and got[(at(0), 1)] == 2


def test_queues(spark, tmp_path):
    at = lambda s: DAY + dt.timedelta(seconds=s)
    batches = [[(at(0), 1, 1), (at(0), 2, 1), (at(1), 3, 1)], [(at(2), 4, 1), (at(50), 5, 1)]]
    got = {r["agent_id"]: r["depart"] for r in feed(spark, tmp_path, batches, lambda s: slots.link_queues(s, 10.0)).collect()}
    df = spark.createDataFrame([r for b in batches for r in b], SCHEMA).withColumns({"ready": F.unix_timestamp("ts").cast("double"), "h": F.lit(10.0)})
    assert got == {r["agent_id"]: r["depart"] for r in queues.single_link(df, "link_id", "agent_id", "ready", "h").collect()}
