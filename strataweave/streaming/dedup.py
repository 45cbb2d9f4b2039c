"""Incremental exact deduplication of arriving files (an extension: the batch method, on Structured Streaming)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.functions.text import content_hash


def first_arrivals(stream: DataFrame, text: str = "text", event_time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Rows whose normalised content did not arrive before, as far back as the watermark: older state is dropped, so a copy that comes later than ``delay`` passes. The batch operator is exact."""
    return stream.withColumn("norm_hash", content_hash(F.col(text))).withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["norm_hash"])
