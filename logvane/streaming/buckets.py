"""Three-second buckets of a stream, each written once, and what is computed from them.

The stream counts logs in short buckets and appends a bucket when the watermark
has passed it. A minute is a second window over the buckets, and the rate at
every tick a sum of the twenty buckets before it; neither looks at a log again.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logvane.operators.activity import (
    BUCKET_MICROS,
    BUCKET_SECONDS,
    RATE_SECONDS,
    TIMELINE_BUCKETS,
    trailing_rate,
)


def bucket_number(start: Column) -> Column:
    return F.floor(F.unix_micros(start) / F.lit(BUCKET_MICROS)).cast("bigint")


def stream_buckets(scored: DataFrame, watermark: str) -> DataFrame:
    """window, logs and alerts of every bucket that holds a log (append mode)."""
    return (
        scored.withWatermark("created_at", watermark)
        .groupBy(F.window("created_at", f"{BUCKET_SECONDS} seconds"))
        .agg(F.count("*").alias("logs"), F.count_if("is_alert").alias("alerts"))
    )


def numbered(buckets: DataFrame) -> DataFrame:
    return buckets.select(bucket_number(F.col("window.start")).alias("bucket"), "logs", "alerts")


def stream_minutes(buckets: DataFrame) -> DataFrame:
    """minute, logs, alerts and busy buckets of every minute: a window over the buckets' windows (append mode)."""
    return (
        buckets.groupBy(F.window(F.window_time("window"), f"{RATE_SECONDS} seconds").alias("minute"))
        .agg(F.sum("logs").alias("logs"), F.sum("alerts").alias("alerts"), F.count("*").alias("busy_buckets"))
        .select(
            F.floor(F.unix_micros("minute.start") / F.lit(RATE_SECONDS * 1_000_000)).cast("bigint").alias("minute"),
            "logs",
            "alerts",
            "busy_buckets",
        )
    )


def last_buckets(stored: DataFrame, count: int = TIMELINE_BUCKETS, now: datetime | None = None) -> DataFrame:
    """bucket, logs and alerts of the last buckets up to the newest stored one (or ``now``), zeros for empty ones."""
    newest = stored.agg(F.max("bucket")).first()[0] if now is None else int(now.timestamp()) // BUCKET_SECONDS
    if newest is None:
        return stored.select("bucket", "logs", "alerts")
    ticks = stored.sparkSession.range(newest - count + 1, newest + 1).select(F.col("id").alias("bucket"))
    recent = stored.where(F.col("bucket").between(newest - count + 1, newest))
    return ticks.join(recent, "bucket", "left").select(
        "bucket", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("logs", "alerts")]
    )


def minute_rate(stored: DataFrame) -> DataFrame:
    """bucket, logs and logs_per_minute: the sum of the twenty buckets that end with each stored one."""
    return trailing_rate(stored.select("bucket", "logs"))
