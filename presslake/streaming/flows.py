"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_by_key(stream: DataFrame, ts: str, keys: list[str], delay: str) -> DataFrame:
    """Rows whose keys weren't seen within the watermark (STR-4)."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def counts_by_window(stream: DataFrame, ts: str, keys: list[str], width: str, delay: str) -> DataFrame:
    """Counts by key and tumbling window; late rows within the delay still count (STR-7)."""
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("span"), *keys).agg(F.count("*").alias("n")).select(F.col("span.start").alias("start"), *keys, "n")
