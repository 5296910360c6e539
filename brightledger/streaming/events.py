"""Streams of events (event_id, ts, user_id, event_type, value).

Each function takes a streaming or a batch DataFrame, so that a stream's result can
be held against the batch's.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "1 day"


def scratch(spark: SparkSession) -> str:
    """A new folder for a stream's output and checkpoint: in the shared folder that ``spark.checkpoint.dir`` names, or, on a local master, a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", "")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(shared or tempfile.mkdtemp(prefix='brightledger-')).rstrip('/')}/stream-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files of events as a stream, a file at a time."""
    found = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    return found.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", LATE).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes") -> DataFrame:
    """Counts of windows that overlap: an event is in width / step of them."""
    return events.withWatermark("ts", LATE).groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return (
        events.withWatermark("ts", LATE).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
        .select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
    )


def deduplicated(events: DataFrame) -> DataFrame:
    """Each event once, as long as its repeats come within the watermark."""
    if events.isStreaming:
        return events.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])


#: States of a task, and what its events do to it. A lease that isn't renewed runs out; the third failure is final.
LEASE_SECONDS, MOST_ATTEMPTS = 180, 3
TASK_OUT = "task_id long, event_id long, state string, attempts int"
TASK_STATE = "state string, attempts int, lease_until double, last_at double, last_event long"


def task_states(events: DataFrame) -> DataFrame:
    """State of every task (task_id) after each of its events (event_id, ts, action), kept across batches.

    Actions: claim takes a queued task, or a running one whose lease ran out, for
    LEASE_SECONDS; heartbeat renews a lease that holds; complete and fail end a running
    task, but a failed one is queued again until its third attempt. Other actions, and
    such that come at the wrong time, change nothing. Events of a batch are taken in
    order of (ts, event_id); one that isn't behind the last one taken is passed over, so
    that events may be delivered again.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, attempts, lease, *last = held.get if held.exists else ("queued", 0, 0.0, float("-inf"), -1)
        out = []
        for event_id, at, action in pd.concat(list(batches)).sort_values(["ts", "event_id"])[["event_id", "ts", "action"]].itertuples(index=False):
            now, event_id = at.timestamp(), int(event_id)
            if (now, event_id) <= tuple(last):
                continue
            last, alive = [now, event_id], state == "running" and now <= lease
            if action == "claim" and (state == "queued" or (state == "running" and not alive)):
                state, attempts, lease = "running", attempts + 1, now + LEASE_SECONDS
            elif action == "heartbeat" and alive:
                lease = now + LEASE_SECONDS
            elif action == "complete" and alive:
                state = "completed"
            elif action == "fail" and alive:
                state = "queued" if attempts < MOST_ATTEMPTS else "failed"
            out.append((int(key[0]), event_id, state, attempts))
        held.update((state, attempts, lease, *last))
        yield pd.DataFrame(out, columns=["task_id", "event_id", "state", "attempts"])

    return events.groupBy("task_id").applyInPandasWithState(step, TASK_OUT, TASK_STATE, "append", GroupStateTimeout.NoTimeout)


def write_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run a stream over what is there into a table with a folder for each batch: a batch that is run again replaces its own folder, so nothing is written twice."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_to_end(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there and return its result as a table held in memory: for small streams and tests."""
    name = f"stream_{uuid.uuid4().hex}"
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
