"""The live board: totals, categories, sources and lists of one stream, with what was stored before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logvane.functions.coerce import finite
from logvane.functions.severity import severity, technique
from logvane.operators.activity import SEED_ALERTS, event_kind
from logvane.operators.triage import tier_counts, top_alerts
from logvane.session import materialize
from logvane.streaming.keyed_state import Folded, KeyedState, largest, total
from logvane.streaming.live import LiveLists


def _alert_score() -> Column:
    return F.when(F.col("is_alert"), finite(F.col("anomaly_score")))


def totals_state(spark: SparkSession, path: str) -> KeyedState:
    """Logs, alerts, alerts of each tier, and sum and number of the alerts' scores."""
    score = _alert_score()
    counts = [
        total("total_logs", F.count("*")),
        total("total_alerts", F.count_if("is_alert")),
        *[total(name, c) for name, c in zip(("low", "medium", "high", "critical"), tier_counts())],
        total("score_sum", F.sum(score)),
        total("score_count", F.count(score)),
    ]
    return KeyedState(spark, path, [], counts)


def category_state(spark: SparkSession, path: str) -> KeyedState:
    """Alerts and their scores for each event type, with its technique; give it ``alerts_by_kind``."""
    score = _alert_score()
    figures = [
        total("alerts", F.count("*")),
        total("score_sum", F.sum(score)),
        total("score_count", F.count(score)),
        largest("technique", technique(F.col("event_type"))),
    ]
    return KeyedState(spark, path, ["kind"], figures)


def alerts_by_kind(logs: DataFrame) -> DataFrame:
    return logs.where("is_alert").withColumn("kind", event_kind(F.col("event_type")))


def category_view(state: KeyedState) -> DataFrame:
    """event_type, alerts, mean_score and technique as they stand."""
    return state.read().select(
        F.col("kind").alias("event_type"),
        "alerts",
        F.try_divide("score_sum", "score_count").alias("mean_score"),
        "technique",
    )


def overall_view(state: KeyedState) -> DataFrame:
    """One row: the mean score of all scored alerts (0 without any) and the techniques seen, in order."""
    return state.read().agg(
        F.coalesce(F.try_divide(F.sum("score_sum"), F.sum("score_count")), F.lit(0.0)).alias("mean_score"),
        F.array_sort(F.collect_set("technique")).alias("techniques"),
    )


def source_state(spark: SparkSession, path: str, idle_seconds: int | None = None) -> KeyedState:
    """Events, newest log, newest tier and whether it ever alerted, of each source; give it ``from_sources``."""
    tier = severity(F.col("anomaly_score"), F.col("is_alert"))
    # Structures compare by time and id first, which name a log.
    newest = F.struct("created_at", "id", "anomaly_score", "event_type")
    tiered = F.when(tier.isNotNull(), F.struct("created_at", "id", tier.alias("severity")))
    figures = [
        total("events", F.count("*")),
        largest("last_time", F.col("created_at")),
        largest("newest", newest),
        Folded("ever_alert", F.bool_or("is_alert"), F.bool_or),
        largest("tiered", tiered),
    ]
    return KeyedState(
        spark, path, ["source_ip"], figures, None if idle_seconds is None else "last_time", idle_seconds
    )


def from_sources(logs: DataFrame) -> DataFrame:
    return logs.where(F.col("source_ip").isNotNull() & (F.col("source_ip") != ""))


def source_view(state: DataFrame) -> DataFrame:
    """The columns of ``activity.source_ip_state``, from a state or its changes."""
    return state.select(
        "source_ip",
        "events",
        "last_time",
        F.col("newest.anomaly_score").alias("last_score"),
        F.col("newest.event_type").alias("last_event"),
        "ever_alert",
        F.col("tiered.severity").alias("last_severity"),
    )


class LiveBoard:
    """All running figures of a stream, each micro-batch read once.

    ``seed`` starts it from the stored table: totals from all stored logs, and
    everything else from the most anomalous stored alerts, as a board does that
    is opened in the middle of a stream.
    """

    def __init__(self, spark: SparkSession, path: str, idle_seconds: int | None = None):
        self.totals = totals_state(spark, f"{path}/totals")
        self.categories = category_state(spark, f"{path}/categories")
        self.sources = source_state(spark, f"{path}/sources", idle_seconds)
        self.lists = LiveLists(spark, f"{path}/lists")

    def seed(self, stored: DataFrame, alerts: int = SEED_ALERTS) -> None:
        self.totals.seed(stored)
        top = materialize(top_alerts(stored, alerts))
        self.categories.seed(alerts_by_kind(top))
        self.sources.seed(from_sources(top))
        self.lists.seed(top)

    def merge(self, scored: DataFrame, batch: int) -> None:
        """One micro-batch into all figures; written once, so its source is not read for each."""
        rows = materialize(scored)
        self.totals.add(rows, batch)
        self.categories.add(alerts_by_kind(rows), batch)
        self.sources.add(from_sources(rows), batch)
        self.lists.merge(rows, batch)

    def start(self, scored: DataFrame, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        writer = scored.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.merge)
        if available_now:
            writer = writer.trigger(availableNow=True)
        return writer.start()
