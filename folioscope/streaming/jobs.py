"""Streaming forms of intake, leases, daily windows and new-object processing.

All run with ``availableNow`` as well as continuously, and give what their batch queries give on the same input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def job_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def first_requests(jobs: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Each (member, request) once; a repeat within the lateness is dropped."""
    return jobs.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["member_id", "request"])


def daily(jobs: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Counts and sums by day and kind; a day is final when the watermark has passed it."""
    return jobs.withWatermark("at", lateness).groupBy(F.window("at", "1 day"), "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("seconds").alias("seconds")).select(F.col("window.start").alias("day"), "kind", "n", "seconds")


def leases(jobs: DataFrame, lease_seconds: int, lateness: str = "1 hour") -> DataFrame:
    """member_id, status: done or failed when such an event comes, expired when the lease runs out in event time before one does."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"member_id": [key[0]], "status": ["expired"]})
            return
        last = state.get[0] if state.exists else 0
        ended = None
        for f in frames:
            for k, ms in sorted(zip(f["kind"], f["at_ms"]), key=lambda x: x[1]):
                last = max(last, int(ms))
                ended = {"purchase": "done", "error": "failed"}.get(k, ended)
        if ended:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"member_id": [key[0]], "status": [ended]})
        else:
            state.update((last,))
            state.setTimeoutTimestamp(max(last + lease_seconds * 1000, state.getCurrentWatermarkMs() + 1))

    slim = jobs.withWatermark("at", lateness).select("member_id", "kind", "at", (F.unix_millis("at")).alias("at_ms"))
    return slim.groupBy("member_id").applyInPandasWithState(step, "member_id long, status string", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def process_new(stream: DataFrame, done: Callable[[], DataFrame], key: str, sink: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Each new object once: the checkpoint holds what was read, the anti-join what an earlier run finished.

    ``sink`` appends; a batch that is run again finds its own rows done.
    """

    def batch(df: DataFrame, _: int) -> None:
        sink(df.dropDuplicates([key]).join(done().select(key), key, "left_anti"))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
