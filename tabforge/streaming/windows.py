"""Windowed profiles of event streams: counts by bin per event-time window, and drift against a reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.operators.binning import Bins, indexed, name_of
from tabforge.operators.drift import psi


def binned_counts(events: DataFrame, bins: list[Bins], time: str = "ts", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """window_start, column_name, bin, rows of a stream or a table; events later than the watermark are left out of a
    stream's windows, whose state is columns * bins rows per open window."""
    src = events.withWatermark(time, late) if events.isStreaming else events
    counts = indexed(src, bins, [F.col(time)]).groupBy(F.window(time, window).alias("w"), "k", "bin").agg(F.count("*").alias("rows"))
    return counts.select(F.col("w.start").alias("window_start"), name_of(bins).alias("column_name"), "bin", "rows")


def window_psi(counts: DataFrame, reference: DataFrame) -> DataFrame:
    """window_start, column_name, psi of each window against a reference's column_name, bin, rows."""
    return psi(counts.withColumn("unit", F.col("window_start").cast("string")), reference, per_unit=True).withColumnRenamed("unit", "window_start")
