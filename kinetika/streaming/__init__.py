"""The same statistics over a stream of frames: windows with a watermark, and running moments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetika.functions.columns import missing_to_null


def windowed_features(frames: DataFrame, group_col: str, time_col: str, value_col: str, window: str = "5 minutes", slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Distribution features of each group and event-time window; rows later than ``lateness`` are left out. Batch input works alike."""
    value = missing_to_null(F.col(value_col))
    timed = frames.withWatermark(time_col, lateness) if frames.isStreaming else frames
    cell = F.window(time_col, window, slide) if slide else F.window(time_col, window)
    made = timed.groupBy(F.col(group_col), cell.alias("w")).agg(F.count(value).alias("length"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"))
    return made.select(group_col, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "length", "mean", "sd", "min", "max")
