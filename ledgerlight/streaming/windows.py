"""Event-time windows, for streams and for batches alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, ts: str = "ts", late: str | None = None) -> DataFrame:
    """Events with a zoned time, and a watermark if ``late`` is given."""
    out = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return out.withWatermark(ts, late) if late else out


def _sums(df: DataFrame, window: Column, by: list[str], value: str) -> DataFrame:
    out = df.groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("decimal(18,6)")).cast("decimal(18,6)").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n", "total")


def tumbling(events: DataFrame, width: str = "1 hour", by: list[str] | None = None, ts: str = "ts", value: str = "value") -> DataFrame:
    return _sums(events, F.window(ts, width), by or [], value)


def sliding(events: DataFrame, width: str = "1 hour", slide: str = "30 minutes", by: list[str] | None = None, ts: str = "ts", value: str = "value") -> DataFrame:
    return _sums(events, F.window(ts, width, slide), by or [], value)


def sessions(events: DataFrame, gap: str = "30 minutes", by: list[str] | None = None, ts: str = "ts", value: str = "value") -> DataFrame:
    return _sums(events, F.session_window(ts, gap), by or ["user_id"], value)


def daily(events: DataFrame, ts: str = "ts", value: str = "value") -> DataFrame:
    return tumbling(events, "1 day", ts=ts, value=value)


def deduplicated(events: DataFrame, key: str = "event_id", ts: str = "ts", late: str = "14 days") -> DataFrame:
    """At-least-once events each once, within the time that rows may come late."""
    return timed(events, ts, late).dropDuplicatesWithinWatermark([key])
