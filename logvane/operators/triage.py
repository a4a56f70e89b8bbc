"""Queries over stored logs: filters, newest, most anomalous, summary."""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logvane.functions.severity import SEVERITIES, in_tier, severity
from logvane.operators.ordering import with_positions
from logvane.schema import RESPONSE_COLUMNS

DEFAULT_LIMIT = 100



def with_severity(logs: DataFrame) -> DataFrame:
    return logs.withColumn("severity", severity(F.col("anomaly_score"), F.col("is_alert")))


def responses(logs: DataFrame) -> DataFrame:
    """Stored columns plus the derived severity; the raw payload is left out."""
    return with_severity(logs.select(*RESPONSE_COLUMNS))


def _utc_date(instant: datetime) -> date:
    if instant.tzinfo is not None:
        instant = instant.astimezone(timezone.utc)
    return instant.date()


def filter_logs(
    logs: DataFrame,
    source_ip: str | None = None,
    is_alert: bool | None = None,
    severity: str | None = None,
    start_time: datetime | None = None,
    end_time: datetime | None = None,
) -> DataFrame:
    """All given filters together; time bounds are [start, end) on created_at.

    Every filter is a plain comparison, so it reaches the Parquet scan; time
    bounds also select partitions when the table has an ``ingest_date``.
    """
    conditions: list[Column] = []
    if source_ip is not None:
        conditions.append(F.col("source_ip") == source_ip)
    if is_alert is not None:
        conditions.append(F.col("is_alert") == F.lit(is_alert))
    if severity is not None:
        conditions.append(in_tier(severity, F.col("anomaly_score"), F.col("is_alert")))
    partitioned = "ingest_date" in logs.columns
    if start_time is not None:
        conditions.append(F.col("created_at") >= F.lit(start_time))
        if partitioned:
            conditions.append(F.col("ingest_date") >= F.lit(_utc_date(start_time)))
    if end_time is not None:
        conditions.append(F.col("created_at") < F.lit(end_time))
        if partitioned:
            conditions.append(F.col("ingest_date") <= F.lit(_utc_date(end_time)))
    for condition in conditions:
        logs = logs.where(condition)
    return logs


def recent_logs(logs: DataFrame, limit: int = DEFAULT_LIMIT, skip: int = 0) -> DataFrame:
    """Newest ingested first; late events do not jump ahead."""
    newest = logs.orderBy(F.desc("created_at"), F.desc("id"))
    if skip:
        newest = newest.offset(skip)
    return newest.limit(limit)


def top_alerts(logs: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Most anomalous alerts first, unscored ones last."""
    return (
        logs.where("is_alert")
        .orderBy(F.desc_nulls_last("anomaly_score"), F.desc("created_at"), F.desc("id"))
        .limit(limit)
    )


def ranked_alerts(logs: DataFrame) -> DataFrame:
    """Every alert with its ``rank``, the most anomalous first, unscored ones last.

    No row is left out and none is sorted on the driver: places come from
    range-partitioned blocks.
    """
    order = [
        F.col("anomaly_score").isNull(),
        -F.col("anomaly_score"),
        -F.unix_micros("created_at"),
        -F.col("id"),
    ]
    placed = with_positions(logs.where("is_alert"), order, "rank")
    return placed.withColumn("rank", F.col("rank") + 1)


def tier_counts() -> list[Column]:
    return [
        F.count_if(in_tier(tier, F.col("anomaly_score"), F.col("is_alert"))).alias(tier)
        for tier in SEVERITIES
    ]


def stats_summary(logs: DataFrame) -> DataFrame:
    """Totals, alert rate and alerts per tier in one aggregate over one scan."""
    # The summary's keys.
    counted = logs.agg(
        F.count("*").alias("total_logs"),
        F.count_if("is_alert").alias("total_alerts"),
        *tier_counts(),
    )
    rate = F.coalesce(
        F.round(F.try_divide("total_alerts", "total_logs"), 4), F.lit(0.0)
    )
    return counted.select(
        "total_logs", "total_alerts", rate.alias("alert_rate"), *SEVERITIES
    )


def alerts_by_severity(logs: DataFrame) -> DataFrame:
    """One row per tier, all four always present."""
    tiers = F.array(
        *[F.struct(F.lit(t).alias("severity"), F.col(t).alias("alerts")) for t in SEVERITIES]
    )
    return logs.agg(*tier_counts()).select(F.inline(tiers))


def search_logs(logs: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring over the text shown for a log."""
    shown = with_severity(logs) if "severity" not in logs.columns else logs
    wanted = text.strip().lower()
    if not wanted:
        return shown
    # The signs between and in place of the shown fields.
    row_text = F.concat_ws(
        " ",
        F.date_format("created_at", "HH:mm:ss"),
        F.coalesce("event_type", F.lit("—")),
        F.concat(
            F.coalesce("source_ip", F.lit("—")),
            F.lit(" → "),
            F.coalesce("destination_ip", F.lit("—")),
        ),
        F.coalesce("protocol", F.lit("—")),
        F.format_string("%.2f", F.coalesce("anomaly_score", F.lit(0.0))),
        F.coalesce("severity", F.lit("benign")),
    )
    return shown.where(F.contains(F.lower(row_text), F.lit(wanted)))


def stream_filter(logs: DataFrame, tier: str | None = None, alerts_only: bool = False) -> DataFrame:
    """Severity chip and alerts-only switch of the live view."""
    shown = with_severity(logs) if "severity" not in logs.columns else logs
    if tier is not None:
        shown = shown.where(in_tier(tier, F.col("anomaly_score"), F.col("is_alert")))
    if alerts_only:
        shown = shown.where(F.col("severity").isNotNull())
    return shown
