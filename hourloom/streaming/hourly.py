"""The hourly mean over a stream: the one operator here with a natural incremental form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_mean_stream(points: DataFrame, by: list[str], ts: str, value: str, lateness: str = "2 hours") -> DataFrame:
    """Mean per key and UTC hour of a streaming frame; an hour is final once the watermark has passed it."""
    hours = points.withWatermark(ts, lateness).groupBy(*by, F.window(ts, "1 hour"))
    return hours.agg(F.avg(value).alias(value)).select(*by, F.col("window.start").alias(ts), value)
