"""Alerts of one source that follow each other closely, as incidents.

An incident goes on while the next alert of its source comes less than the gap
after the one before. In a batch, alerts are first collapsed to slots of a
fraction of the gap (alerts of one slot always belong together), combined before
the shuffle; only slots are ordered. So a source with a third of all alerts
costs as many rows as it has busy slots. A stream uses session windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logvane.functions.severity import severity, severity_weight, technique

GAP_SECONDS = 900
# Slots in a gap; two alerts in one slot are closer than the gap.
SLOTS_PER_GAP = 15


def _has_source() -> Column:
    return F.col("source_ip").isNotNull() & (F.col("source_ip") != "") & F.col("created_at").isNotNull()


def _tier_weight() -> Column:
    return severity_weight(severity(F.col("anomaly_score"), F.col("is_alert")))


def _tier_of(weight: Column) -> Column:
    """The tier that has a weight; null where no alert has one."""
    tiers = F.array(*[F.lit(t) for t in ("low", "medium", "high", "critical")])
    return F.get(F.filter(tiers, lambda t: severity_weight(t) == weight), 0)


def incident_id(source: Column, start: Column) -> Column:
    """Names an incident by where and when it began, so that later alerts don't change it."""
    return F.concat_ws("@", source, F.unix_micros(start).cast("string"))


def incidents(logs: DataFrame, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """Incidents of stored logs: id, source_ip, start_time, end_time, alerts, worst_severity, techniques.

    An alert exactly one gap after another starts a new incident. Logs without a
    source or a time are left out; alerts without a tier count but rank below
    all tiers; ``techniques`` are the different known ones in order. Repeated
    rows are counted each; an empty table has none.
    """
    slot_micros = gap_seconds * 1_000_000 // SLOTS_PER_GAP
    slots = (
        logs.where(F.col("is_alert") & _has_source())
        .groupBy("source_ip", F.floor(F.unix_micros("created_at") / F.lit(slot_micros)).alias("slot"))
        .agg(
            F.min("created_at").alias("first"),
            F.max("created_at").alias("last"),
            F.count("*").alias("alerts"),
            F.max(_tier_weight()).alias("weight"),
            F.collect_set(technique(F.col("event_type"))).alias("techniques"),
        )
    )
    ordered = Window.partitionBy("source_ip").orderBy("slot")
    apart = F.unix_micros("first") - F.unix_micros(F.lag("last").over(ordered)) >= gap_seconds * 1_000_000
    numbered = slots.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn(
        "number", F.sum("new").over(ordered)
    )
    return (
        numbered.groupBy("source_ip", "number")
        .agg(
            F.min("first").alias("start_time"),
            F.max("last").alias("end_time"),
            F.sum("alerts").alias("alerts"),
            F.max("weight").alias("weight"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("techniques")))).alias("techniques"),
        )
        .select(
            incident_id(F.col("source_ip"), F.col("start_time")).alias("incident_id"),
            "source_ip",
            "start_time",
            "end_time",
            "alerts",
            _tier_of(F.col("weight")).alias("worst_severity"),
            "techniques",
        )
    )


def stream_incidents(logs: DataFrame, watermark: str, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """The same incidents of a stream, each once, when the watermark has passed its end by the gap."""
    return (
        logs.where(F.col("is_alert") & _has_source())
        .withWatermark("created_at", watermark)
        .groupBy(F.session_window("created_at", f"{gap_seconds} seconds"), "source_ip")
        .agg(
            F.min("created_at").alias("start_time"),
            F.max("created_at").alias("end_time"),
            F.count("*").alias("alerts"),
            F.max(_tier_weight()).alias("weight"),
            F.array_sort(F.collect_set(technique(F.col("event_type")))).alias("techniques"),
        )
        .select(
            incident_id(F.col("source_ip"), F.col("start_time")).alias("incident_id"),
            "source_ip",
            "start_time",
            "end_time",
            "alerts",
            _tier_of(F.col("weight")).alias("worst_severity"),
            "techniques",
        )
    )
