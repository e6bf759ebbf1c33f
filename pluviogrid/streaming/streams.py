"""Structured-streaming forms of the resampling and spell operators (an addition: the batch forms are the core)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resample_stream(stream: DataFrame, keys: list[str], width: str = "1 hour", late: str = "10 minutes", ts: str = "ts", col: str = "value") -> DataFrame:
    """Totals, means and maxima of tumbling windows; rows later than the watermark go."""
    d = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    g = d.groupBy(*keys, F.window(ts, width)).agg(F.sum(col).alias("total"), F.avg(col).alias("mean"), F.max(col).alias("largest"), F.count("*").alias("n"))
    return g.select(*keys, F.col("window.start").alias("from"), F.col("window.end").alias("to"), "total", "mean", "largest", "n")


def spell_stream(stream: DataFrame, keys: list[str], step: str = "1 hour", threshold: float = 1.0, late: str = "1 hour", ts: str = "ts", col: str = "value") -> DataFrame:
    """Wet spells of a regular series as session windows: rows exactly a step apart belong together."""
    d = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).where(F.col(col) >= threshold)
    g = d.groupBy(*keys, F.session_window(ts, step)).agg(F.count("*").alias("duration"), F.sum(col).alias("total"), F.max(col).alias("peak"))
    return g.select(*keys, F.col("session_window.start").alias("start"), "duration", "total", "peak")
