"""Counters, sessions and first sightings over streams, by event time with a watermark.

The batch forms count within (key, window) in the order of events; here a window's total is final once
the watermark has passed it, and later events are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LATE = "1 hour"


def window_totals(events: DataFrame, key: str, amount: Column, *, at: str = "ts", size: str = "1 hour", late: str = LATE) -> DataFrame:
    """key, window_start and value: the amount of each key in each fixed window."""
    per = events.withWatermark(at, late).groupBy(key, F.window(at, size).alias("w")).agg(F.sum(amount).alias("value"))
    return per.select(key, F.col("w.start").alias("window_start"), "value")


def sessions(events: DataFrame, key: str, *, at: str = "ts", gap: str = "12 hours", late: str = LATE) -> DataFrame:
    """key, started_at, ended_at and n_events of sessions that end after a gap."""
    per = events.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n_events"))
    return per.select(key, F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "n_events")


def first_seen(events: DataFrame, key: str, *, at: str = "ts", late: str = LATE) -> DataFrame:
    """The first event of each key; keys are forgotten once the watermark has passed them."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
