"""Structured Streaming jobs built from the batch operators."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logvane.functions.coerce import finite
from logvane.functions.severity import severity, technique
from logvane.operators.activity import (
    BUCKET_SECONDS,
    RATE_SECONDS,
    RECENT_ALERTS,
    RECENT_LOGS,
    SEED_ALERTS,
    THREAT_LOGS,
    event_kind,
    source_ip_aggregates,
    threat_index,
)
from logvane.operators.scoring import Detector, score_logs
from logvane.operators.triage import recent_logs, responses, tier_counts, top_alerts
from logvane.operators.validation import (
    parse_messages,
    quarantined_messages,
    valid_messages,
)
from logvane.session import materialize
from logvane.sources.log_table import LogTable, assign_ids

WATERMARK = "1 minute"
# Frame times keep every microsecond that a log has.
FRAME_TIME = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX"


def live_frames(scored: DataFrame) -> DataFrame:
    """One JSON frame per scored log, benign and unscored ones too."""
    shown = responses_with_features(scored)
    data = F.struct(*shown.columns)
    return shown.select(
        F.to_json(
            F.struct(F.lit("log").alias("type"), data.alias("data")),
            {"ignoreNullFields": "false", "timestampFormat": FRAME_TIME},
        ).alias("value")
    )


def responses_with_features(scored: DataFrame) -> DataFrame:
    """The response columns with the explanation riding along."""
    shown = responses(scored)
    tier = severity(F.col("anomaly_score"), F.col("is_alert"))
    return scored.select(
        *[c for c in shown.columns if c != "severity"],
        tier.alias("severity"),
        "top_features",
    )


def parsed_messages(messages: DataFrame) -> DataFrame:
    """Parse and validate messages; rejected ones keep their reasons."""
    parsed = parse_messages(messages)
    if "created_at" not in parsed.columns:
        # In a stream this is the micro-batch's recorded time, the same on a retry.
        parsed = parsed.withColumn("created_at", F.current_timestamp())
    return parsed


def start_ingest(
    messages: DataFrame,
    table: LogTable,
    detector: Detector | None,
    checkpoint: str,
    quarantine_path: str,
    publish_path: str | None = None,
    available_now: bool = False,
    writer_name: str | None = None,
) -> StreamingQuery:
    """Score every arriving log, store it and publish it.

    A writer's name stands for its checkpoint (by default it is a hash of the
    folder), so streams with checkpoints of their own never replace each
    other's logs. All three outputs of a micro-batch are keyed by writer and
    number and replaced as a whole, so a retried batch leaves no duplicates.
    Rejected messages are split off before anything is scored; every step
    reads the written copy of the one before.
    """
    table.create_if_absent()
    name = writer_name or f"stream-{hashlib.sha256(checkpoint.encode()).hexdigest()[:32]}"

    def replace(frame: DataFrame, path: str, batch: int, fmt: str) -> None:
        (
            frame.withColumns({"writer": F.lit(name), "batch": F.lit(batch)})
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("writer", "batch")
            .format(fmt)
            .save(path)
        )

    def handle(parsed: DataFrame, batch: int) -> None:
        parsed = materialize(parsed)
        kept = list(messages.columns)
        logs = score_logs(valid_messages(parsed), detector)
        if "id" not in logs.columns:
            logs = assign_ids(logs, batch)
        stored = table.append(logs, batch, name)
        replace(quarantined_messages(parsed, kept), quarantine_path, batch, "json")
        if publish_path is not None:
            replace(live_frames(stored), publish_path, batch, "text")

    writer = (
        parsed_messages(messages)
        .writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(handle)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def stream_totals(scored: DataFrame) -> DataFrame:
    """Running totals of a stream (complete mode)."""
    alert_score = F.when(F.col("is_alert"), finite(F.col("anomaly_score")))
    return scored.groupBy().agg(
        F.count("*").alias("total_logs"),
        F.count_if("is_alert").alias("total_alerts"),
        *tier_counts(),
        F.sum(alert_score).alias("score_sum"),
        F.count(alert_score).alias("score_count"),
    )


def seeded_totals(stored: DataFrame, streamed: DataFrame) -> DataFrame:
    """Stored summary plus what the stream has added since (one row each)."""
    counts = ["total_logs", "total_alerts", "low", "medium", "high", "critical"]
    return stored.select(*counts).unionByName(streamed.select(*counts)).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts]
    )


def stream_alert_timeline(scored: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Alerts per 3-second bucket."""
    return (
        scored.where("is_alert")
        .withWatermark("created_at", watermark)
        .groupBy(F.window("created_at", f"{BUCKET_SECONDS} seconds"))
        .agg(F.count("*").alias("alerts"))
        .select(_bucket_of(F.col("window.start")).alias("bucket"), "alerts")
    )


def stream_logs_per_minute(scored: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Logs in each minute, one minute ending every 3 seconds."""
    sliding = F.window("created_at", f"{RATE_SECONDS} seconds", f"{BUCKET_SECONDS} seconds")
    return (
        scored.withWatermark("created_at", watermark)
        .groupBy(sliding)
        .agg(F.count("*").alias("logs_per_minute"))
        .select((_bucket_of(F.col("window.end")) - 1).alias("bucket"), "logs_per_minute")
    )


def _bucket_of(instant: Column) -> Column:
    return F.floor(F.unix_micros(instant) / F.lit(BUCKET_SECONDS * 1_000_000)).cast("bigint")


def stream_source_state(scored: DataFrame) -> DataFrame:
    """Running state of every source."""
    return (
        scored.where(F.col("source_ip").isNotNull() & (F.col("source_ip") != ""))
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


def stream_categories(scored: DataFrame) -> DataFrame:
    """Running alerts and mean score per event type, with its technique."""
    kind = event_kind(F.col("event_type"))
    return (
        scored.where("is_alert")
        .groupBy(kind.alias("event_type"))
        .agg(F.count("*").alias("alerts"), F.avg(finite(F.col("anomaly_score"))).alias("mean_score"))
        .withColumn("technique", technique(F.col("event_type")))
    )


class LiveLists:
    """Newest logs, newest alerts and the current threat index of a stream.

    Each micro-batch merges the previous short list with its own newest rows.
    A list is written per batch number; the previous one is read back, so the
    state survives restarts and a retried batch gives the same list.
    """

    _columns = [
        "id", "created_at", "source_ip", "event_type", "anomaly_score", "is_alert",
    ]

    def __init__(
        self, spark: SparkSession, path: str, logs: int = RECENT_LOGS, alerts: int = RECENT_ALERTS
    ):
        self.spark = spark
        self.path = path
        self.sizes = {"logs": max(logs, THREAT_LOGS), "alerts": alerts}
        self.shown = logs
        self.seeded = False
        self.batch: int | None = None

    def _at(self, batch: int, name: str) -> str:
        return f"{self.path}/batch={batch}/{name}"

    def seed(self, table: DataFrame) -> None:
        """Start from the most anomalous stored alerts."""
        top = top_alerts(table, SEED_ALERTS).select(*self._columns)
        for name in self.sizes:
            top.write.mode("overwrite").parquet(self._at(-1, name))
        self.batch, self.seeded = -1, True

    def merge(self, scored: DataFrame, batch: int) -> None:
        for name, size in self.sizes.items():
            rows = scored.select(*self._columns)
            if name == "alerts":
                rows = rows.where("is_alert")
            newest = recent_logs(rows, size)
            if batch > 0 or self.seeded:
                before = self.spark.read.parquet(self._at(batch - 1, name))
                newest = recent_logs(before.unionByName(newest), size)
            newest.write.mode("overwrite").parquet(self._at(batch, name))
        self.batch = batch

    def recent_logs(self) -> DataFrame:
        return recent_logs(self.spark.read.parquet(self._at(self.batch, "logs")), self.shown)

    def recent_alerts(self) -> DataFrame:
        return self.spark.read.parquet(self._at(self.batch, "alerts"))

    def threat_index(self) -> DataFrame:
        return threat_index(self.spark.read.parquet(self._at(self.batch, "logs")))

    def start(self, scored: DataFrame, checkpoint: str, available_now: bool = False):
        writer = scored.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
            self.merge
        )
        if available_now:
            writer = writer.trigger(availableNow=True)
        return writer.start()


def run_to_table(
    query: DataFrame, path: str, checkpoint: str, mode: str = "complete"
) -> DataFrame:
    """Drain the available input of an aggregating stream into a Parquet folder.

    ``complete`` replaces the folder with each batch's whole result; ``append``
    uses the file sink, whose log makes every row land exactly once.
    """
    spark = query.sparkSession
    if mode == "append":
        running = (
            query.writeStream.format("parquet")
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(availableNow=True)
            .start(path)
        )
    elif mode != "complete":
        raise ValueError("only append and complete results can be written as a whole")
    else:
        running = (
            query.writeStream.option("checkpointLocation", checkpoint)
            .outputMode(mode)
            .foreachBatch(lambda result, _: result.write.mode("overwrite").parquet(path))
            .trigger(availableNow=True)
            .start()
        )
    running.awaitTermination()
    return spark.read.parquet(path)
