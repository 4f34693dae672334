"""The profile over a stream: windows with a watermark, sessions, deduplication, and the state of each sensor."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def read_events(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_profile(events: DataFrame, late: str | None = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and means by quarter of an hour, or by windows that slide.

    ``late`` None: the stream has its watermark already, as after ``deduplicated``.
    """
    marked = events if late is None else events.withWatermark("ts", late)
    window = F.window("ts", "15 minutes") if slide is None else F.window("ts", "15 minutes", slide)
    return marked.groupBy(window, "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of a sensor's readings without a longer gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


STATE = "n bigint, total double, last timestamp"


def sensor_states(events: DataFrame, jump: float = 50.0, late: str = "1 hour", idle_ms: int = 3_600_000) -> DataFrame:
    """(user_id, n, mean_value, jumps): after each batch, what a sensor has sent so far, and how many of the batch's readings lie far off the mean before them.

    A sensor's state is three numbers; it goes when the watermark passes its last reading by ``idle_ms``.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, total, last = state.get if state.exists else (0, 0.0, None)
        jumps = 0
        rows = pd.concat(frames).sort_values(["ts", "event_id"])
        for value in rows["value"].dropna():
            jumps += n > 0 and abs(value - total / n) > jump
            n, total = n + 1, total + float(value)
        latest = rows["ts"].max()
        last = latest if last is None or latest > last else last
        state.update((n, total, last))
        state.setTimeoutTimestamp(max(int(last.timestamp() * 1000), state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "mean_value": [total / n if n else None], "jumps": [int(jumps)]})

    keyed = events.withWatermark("ts", late).select("user_id", "event_id", "ts", "value").groupBy("user_id")
    return keyed.applyInPandasWithState(step, "user_id bigint, n bigint, mean_value double, jumps bigint", STATE, "update", GroupStateTimeout.EventTimeTimeout)
