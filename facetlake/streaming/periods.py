"""Periods over event time, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def period_of(ts: Column, boundaries: Sequence[str]) -> Column:
    """1 before the first boundary, 2 before the second, ...; null from the last one on."""
    out = None
    for i, b in enumerate(boundaries, 1):
        before = ts < F.to_timestamp(F.lit(b))
        out = F.when(before, i) if out is None else out.when(before, i)
    return out


def period_counts(events: DataFrame, *, width: str = "10 days", late: str | None = "1 day", key: str = "user_id", kind: str = "interaction_type", ts: str = "ts") -> DataFrame:
    """Reactions of each key in tumbling windows; works on a stream (late rows are dropped after the watermark; None if one is set upstream) and on a table."""
    rows = events.withWatermark(ts, late) if events.isStreaming and late else events
    return rows.groupBy(F.window(ts, width), key, kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, kind, "n")


def once(events: DataFrame, keys: Sequence[str], late: str = "1 day", ts: str = "ts") -> DataFrame:
    """Each key once within the watermark: what a repeated delivery repeats is dropped."""
    if events.isStreaming:
        return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))
    return events.dropDuplicates(list(keys))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day", key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Session windows: events of a key with less than ``gap`` between them."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")
