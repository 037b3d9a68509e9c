"""Streams of events: windows with a bound on lateness, duplicates dropped, and each record's best match kept up to date.

These go beyond a batch linkage; the same functions take batch and streaming frames, so tests can hold one against the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of each window and event type; rows later than `late` are dropped on a stream."""
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return windows.agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of a user's events with no longer a pause than `gap`."""
    runs = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return runs.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def without_repeats(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event_id once; on a stream, within the lateness bound, so that state stays bounded."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])


def best_matches(scored: DataFrame) -> DataFrame:
    """From a stream of (rid, s1, p) the best entity of each record so far, ties to the smaller: emitted when it changes."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get if state.exists else None
        best = old
        for pdf in batches:
            for s1, p in zip(pdf["s1"], pdf["p"], strict=True):
                if best is None or (p, -s1) > (best[1], -best[0]):
                    best = (int(s1), float(p))
        if best != old:
            state.update(best)
            yield pd.DataFrame({"rid": [key[0]], "s1": [best[0]], "p": [best[1]]})

    return scored.groupBy("rid").applyInPandasWithState(
        update, "rid long, s1 long, p double", "s1 long, p double", "update", GroupStateTimeout.NoTimeout
    )
