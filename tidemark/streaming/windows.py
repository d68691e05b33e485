"""Forward-window labels and running counts over event streams.

Label windows are (t, t + step].  Spark's time windows are [start, end), so event times are shifted back by one
microsecond before they are assigned, and the shift stays inside this module.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import interval_text, quoted


def window_labels(events: DataFrame, time_col: str, entity_col: str, step: timedelta, late: str = "1 hour", value_col: str | None = None) -> DataFrame:
    """(timestamp, entity, n[, total]) per window on the step's grid; batch or stream, one state per window and entity."""
    at = (F.col(quoted(time_col)).cast("timestamp") - F.expr("INTERVAL 1 MICROSECOND")).alias("_at")
    rows = events.select(at, F.col(quoted(entity_col)), *([F.col(quoted(value_col)).alias("_v")] if value_col else []))
    if rows.isStreaming:
        rows = rows.withWatermark("_at", late)
    grouped = rows.groupBy(F.window("_at", interval_text(step)), quoted(entity_col)).agg(
        F.count(F.lit(1)).alias("n"), *([F.sum("_v").alias("total")] if value_col else [])
    )
    return grouped.select(F.col("window.start").cast("timestamp_ntz").alias("timestamp"), *[c for c in grouped.columns if c != "window"])
