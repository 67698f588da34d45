"""One-minute counts as a running stream result, for consumers without the stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_rollup(df: DataFrame, watermark: str) -> DataFrame:
    """Rows per minute, service and level; rows and state older than the watermark are dropped,
    so the caller states it.

    The stored rollup has no such bound: there a late row simply adds a delta.
    """
    return (
        df.withWatermark("timestamp", watermark)
        .groupBy(F.window("timestamp", "1 minute").alias("w"), "service", "level")
        .agg(F.count("*").alias("count"))
        .select(F.col("w.start").alias("bucket_start"), "service", "level", "count")
    )
