"""Bars from ticks and from finer bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def floor_to(ts: Column, minutes: int) -> Column:
    """Start of the bar that holds ts; bars are aligned to midnight UTC of the epoch."""
    return F.timestamp_micros(F.floor(F.unix_micros(ts.cast("timestamp")) / (minutes * 60_000_000)) * (minutes * 60_000_000)).cast("timestamp_ntz")


def ticks_to_bars(ticks: DataFrame, minutes: int) -> DataFrame:
    """Open, high, low, close of mid and the tick count per symbol and bar; empty bars do not exist.

    All aggregates combine before the shuffle, so it carries one row per symbol, bar and task.
    """
    at = F.struct("ts", "event_id")
    return ticks.groupBy("symbol", floor_to(F.col("ts"), minutes).alias("bar")).agg(
        F.min_by("mid", at).alias("open"), F.max("mid").alias("high"), F.min("mid").alias("low"), F.max_by("mid", at).alias("close"), F.count("*").cast("double").alias("tick_volume")
    ).withColumnRenamed("bar", "ts")


def resample(bars: DataFrame, minutes: int) -> DataFrame:
    """Coarser bars: first open, highest high, lowest low, last close, summed volume."""
    return bars.groupBy("symbol", floor_to(F.col("ts"), minutes).alias("bar")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("tick_volume").alias("tick_volume")
    ).withColumnRenamed("bar", "ts")
