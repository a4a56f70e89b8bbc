"""Live-view aggregates over the scored log table.

Everything is keyed on ``created_at``. Time buckets are aggregated before any
ordering, so windows only ever see buckets, never raw logs.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logvane.functions.coerce import finite
from logvane.functions.severity import severity, severity_weight, technique, threat_label
from logvane.operators.ordering import CHUNK_ROWS, trailing_mean

# Sizes of the live view.
BUCKET_SECONDS = 3
BUCKET_MICROS = BUCKET_SECONDS * 1_000_000
TIMELINE_BUCKETS = 30
HISTORY_TICKS = 40
THREAT_LOGS = 40
RATE_SECONDS = 60
RECENT_LOGS = 60
RECENT_ALERTS = 25
SEED_ALERTS = 12
TOP_GROUPS = 6


def event_kind(event_type: Column) -> Column:
    """Event type for grouping; blank and missing are "Unknown"."""
    return F.coalesce(F.nullif(event_type, F.lit("")), F.lit("Unknown"))


def category_counts(logs: DataFrame) -> DataFrame:
    """Alerts per event type."""
    return (
        logs.where("is_alert")
        .groupBy(event_kind(F.col("event_type")).alias("event_type"))
        .agg(F.count("*").alias("alerts"))
    )


def top_categories(logs: DataFrame, count: int = TOP_GROUPS) -> DataFrame:
    return category_counts(logs).orderBy(F.desc("alerts"), "event_type").limit(count)


def mean_alert_score(logs: DataFrame) -> DataFrame:
    """Mean score of the scored alerts, 2 decimals; 0 without any."""
    return logs.where("is_alert").agg(
        F.coalesce(F.round(F.avg(finite(F.col("anomaly_score"))), 2), F.lit(0.0)).alias("mean_score"),
        F.count(finite(F.col("anomaly_score"))).alias("scored_alerts"),
    )


def source_ip_aggregates() -> list[Column]:
    """State kept per source; also used by the streaming query."""
    newest = F.struct("created_at", "id")
    tier = severity(F.col("anomaly_score"), F.col("is_alert"))
    last = F.max_by(F.struct("created_at", "anomaly_score", "event_type"), newest)
    # Only an alert that has a tier replaces the remembered one.
    last_tier = F.max_by(tier, F.when(tier.isNotNull(), newest))
    return [
        F.count("*").alias("events"),
        last.alias("last"),
        F.bool_or("is_alert").alias("ever_alert"),
        last_tier.alias("last_severity"),
    ]


def source_ip_state(logs: DataFrame) -> DataFrame:
    """Per source: events, its latest log, whether it ever alerted, last tier."""
    return (
        logs.where(F.col("source_ip").isNotNull() & (F.col("source_ip") != ""))
        .groupBy("source_ip")
        .agg(*source_ip_aggregates())
        .select(
            "source_ip",
            "events",
            F.col("last.created_at").alias("last_time"),
            F.col("last.anomaly_score").alias("last_score"),
            F.col("last.event_type").alias("last_event"),
            "ever_alert",
            "last_severity",
        )
    )


def top_source_ips(logs: DataFrame, count: int = TOP_GROUPS) -> DataFrame:
    """Busiest sources."""
    return (
        logs.where(F.col("source_ip").isNotNull() & (F.col("source_ip") != ""))
        .groupBy("source_ip")
        .agg(F.count("*").alias("events"), F.bool_or("is_alert").alias("ever_alert"))
        .orderBy(F.desc("events"), "source_ip")
        .limit(count)
    )


def with_technique(logs: DataFrame) -> DataFrame:
    """Attach the technique of each event type (null for none)."""
    return logs.withColumn("technique", technique(F.col("event_type")))


def technique_coverage(logs: DataFrame) -> DataFrame:
    """Alerts per observed technique."""
    return (
        with_technique(logs.where("is_alert"))
        .where(F.col("technique").isNotNull())
        .groupBy("technique")
        .agg(F.count("*").alias("alerts"))
    )


def _weight() -> Column:
    tier = severity(F.col("anomaly_score"), F.col("is_alert"))
    return severity_weight(tier)


def _index(mean_weight: Column) -> Column:
    """Rounded half up; 0 without logs."""
    return F.coalesce(F.floor(mean_weight + F.lit(0.5)), F.lit(0)).cast("int")


def threat_index(logs: DataFrame, count: int = THREAT_LOGS) -> DataFrame:
    """Mean severity weight of the newest logs, with its label."""
    newest = (
        logs.select("created_at", "id", _weight().alias("weight"))
        .orderBy(F.desc("created_at"), F.desc("id"))
        .limit(count)
    )
    indexed = newest.agg(_index(F.avg("weight")).alias("threat_index"))
    return indexed.withColumn("threat_label", threat_label(F.col("threat_index")))


def threat_index_by_source(logs: DataFrame, count: int = THREAT_LOGS) -> DataFrame:
    """Current index of every source from its newest logs.

    The rank filter runs before the shuffle too, so each task sends at most
    ``count`` rows per source however busy the source is.
    """
    order = Window.partitionBy("source_ip").orderBy(F.desc("created_at"), F.desc("id"))
    indexed = (
        logs.select("source_ip", "created_at", "id", _weight().alias("weight"))
        .withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= count)
        .groupBy("source_ip")
        .agg(_index(F.avg("weight")).alias("threat_index"))
    )
    return indexed.withColumn("threat_label", threat_label(F.col("threat_index")))


def threat_index_history(
    logs: DataFrame,
    by: tuple[str, ...] = (),
    count: int = THREAT_LOGS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """The index as it stood after every log, overall or per source."""
    averaged = trailing_mean(
        logs.select(*by, "id", "created_at", _weight().alias("weight")),
        F.col("weight"),
        count,
        [F.col("created_at"), F.col("id")],
        by,
        "mean_weight",
        chunk_rows,
    )
    return averaged.select(
        *by, "id", "created_at", _index(F.col("mean_weight")).alias("threat_index")
    )


def time_bucket(instant: Column, seconds: int = BUCKET_SECONDS) -> Column:
    """Number of the bucket an instant falls in, counted from the epoch."""
    return F.floor(F.unix_micros(instant) / F.lit(seconds * 1_000_000)).cast("bigint")


def _instant(micros: int) -> Column:
    return F.timestamp_micros(F.lit(micros))


def _between(logs: DataFrame, start: int, end: int) -> DataFrame:
    """Logs created in [start, end) epoch microseconds.

    The bounds are constants, so they select partitions and row groups.
    """
    logs = logs.where(
        (F.col("created_at") >= _instant(start)) & (F.col("created_at") < _instant(end))
    )
    if "ingest_date" in logs.columns:
        days = F.col("ingest_date").between(
            F.to_date(_instant(start)), F.to_date(_instant(end))
        )
        logs = logs.where(days)
    return logs


def newest_instant(logs: DataFrame, now: datetime | None = None) -> int | None:
    """``now``, or else the time of the newest log, in epoch microseconds.

    Read once as a number; a partitioned table is asked for its last day first.
    """
    if now is not None:
        aware = now if now.tzinfo is not None else now.replace(tzinfo=timezone.utc)
        return (aware - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)
    if "ingest_date" in logs.columns:
        last_day = logs.agg(F.max("ingest_date")).first()[0]
        logs = logs.where(F.col("ingest_date") == F.lit(last_day))
    return logs.agg(F.max(F.unix_micros("created_at"))).first()[0]


def _ticks(spark: SparkSession, newest: int | None, count: int) -> DataFrame:
    """The last ``count`` bucket numbers up to ``newest``; none without it."""
    last = -1 if newest is None else newest // BUCKET_MICROS
    return spark.range(last - count + 1 if newest is not None else 0, last + 1).select(
        F.col("id").alias("bucket")
    )


def alerts_timeline(
    logs: DataFrame, buckets: int = TIMELINE_BUCKETS, now: datetime | None = None
) -> DataFrame:
    """Alerts per 3-second bucket over the last buckets, empty ones as zero."""
    newest = newest_instant(logs, now)
    last = (newest or 0) // BUCKET_MICROS
    counted = (
        _between(logs, (last - buckets + 1) * BUCKET_MICROS, (last + 1) * BUCKET_MICROS)
        .where("is_alert")
        .groupBy(time_bucket(F.col("created_at")).alias("bucket"))
        .agg(F.count("*").alias("alerts"))
    )
    return (
        _ticks(logs.sparkSession, newest, buckets)
        .join(counted, "bucket", "left")
        .select("bucket", F.coalesce("alerts", F.lit(0)).alias("alerts"))
    )


def logs_in_trailing_minute(
    logs: DataFrame, now: datetime | None = None, seconds: int = RATE_SECONDS
) -> DataFrame:
    """Logs of the 60 seconds up to ``now``, or up to the newest log."""
    newest = newest_instant(logs, now)
    if newest is None:
        return logs
    return _between(logs, newest - seconds * 1_000_000 + 1, newest + 1)


def logs_per_minute(logs: DataFrame, chunk_buckets: int = 1200) -> DataFrame:
    """Logs in the minute ending with each 3-second bucket that holds logs."""
    counts = logs.groupBy(time_bucket(F.col("created_at")).alias("bucket")).agg(
        F.count("*").alias("logs")
    )
    return trailing_rate(counts, chunk_buckets)


def trailing_rate(counts: DataFrame, chunk_buckets: int = 1200) -> DataFrame:
    """``counts`` (bucket, logs) with the logs of the minute that ends with each bucket.

    Each hour of buckets is one window partition that carries in the 19 buckets before it.
    """
    width = RATE_SECONDS // BUCKET_SECONDS
    own = F.floor(F.col("bucket") / chunk_buckets).cast("bigint")
    carried = F.pmod("bucket", F.lit(chunk_buckets)) >= chunk_buckets - (width - 1)
    chunked = counts.withColumn("_own", own).withColumn(
        "_chunk",
        F.explode(F.when(carried, F.array(own, own + 1)).otherwise(F.array(own))),
    )
    trailing = Window.partitionBy("_chunk").orderBy("bucket").rangeBetween(-(width - 1), 0)
    return (
        chunked.withColumn("logs_per_minute", F.sum("logs").over(trailing))
        .where(F.col("_chunk") == F.col("_own"))
        .select("bucket", "logs", "logs_per_minute")
    )


def kpi_history(
    logs: DataFrame, ticks: int = HISTORY_TICKS, now: datetime | None = None
) -> DataFrame:
    """Cumulative totals at the last 3-second ticks.

    Everything older than the first tick collapses into one group, so the
    running sum covers ``ticks`` rows whatever the table holds.
    """
    newest = newest_instant(logs, now)
    last = (newest or 0) // BUCKET_MICROS
    bucket = time_bucket(F.col("created_at"))
    scored_alert = F.when(F.col("is_alert"), finite(F.col("anomaly_score")))
    tier = severity(F.col("anomaly_score"), F.col("is_alert"))
    grouped = (
        logs.where(F.col("created_at") < _instant((last + 1) * BUCKET_MICROS))
        .groupBy(F.greatest(bucket, F.lit(last - ticks + 1)).alias("bucket"))
        .agg(
            F.count("*").alias("logs"),
            F.count_if("is_alert").alias("alerts"),
            F.count_if(tier == "critical").alias("critical"),
            F.sum(scored_alert).alias("score_sum"),
            F.count(scored_alert).alias("score_count"),
        )
    )
    until = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)

    def running(name: str) -> Column:
        return F.sum(F.coalesce(name, F.lit(0))).over(until)

    cumulative = _ticks(logs.sparkSession, newest, ticks).join(grouped, "bucket", "left").select(
        "bucket",
        *[running(c).alias(c) for c in ("logs", "alerts", "critical", "score_sum", "score_count")],
    )
    return cumulative.select(
        "bucket",
        "logs",
        "alerts",
        "critical",
        F.coalesce(F.try_divide(F.col("alerts") * 100, "logs"), F.lit(0.0)).alias("alert_rate"),
        F.coalesce(F.try_divide("score_sum", "score_count"), F.lit(0.0)).alias("mean_score"),
    )
