"""Event-time windows on streams (survey X4, X11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(stream: DataFrame, keys: list[str], at: str, value: str, size: str = "15 minutes", delay: str = "1 hour") -> DataFrame:
    """Count and exact sum per key and bucket, emitted once a bucket is complete."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, size), *keys).agg(
        F.count(F.lit(1)).alias("readings"), F.sum(F.col(value).cast("decimal(18,6)")).alias("total"),
    ).select(*keys, F.col("window.start").alias("bucket"), "readings", (F.col("total") / F.col("readings")).cast("double").alias("mean"))


def bursts(stream: DataFrame, keys: list[str], at: str, gap: str, delay: str = "1 hour") -> DataFrame:
    """One row per burst of a key, emitted when it has been quiet for the gap."""
    return stream.withWatermark(at, delay).groupBy(F.session_window(at, gap).alias("burst"), *keys).agg(
        F.count(F.lit(1)).alias("burst_size"), F.max(at).alias("last_at")
    ).select(*keys, "burst_size", "last_at", F.col("burst.end").alias("fires_at"))
