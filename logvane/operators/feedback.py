"""Analysts' verdicts on alerts: the latest one counts, however late or often it arrives."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logvane.session import broadcast_if_small

FALSE_POSITIVE = "false_positive"
# What a verdict change has: the alert's id, the verdict, who gave it, and when.
VERDICT_SCHEMA = "id bigint, verdict string, analyst bigint, decided_at timestamp"


def latest_verdicts(changes: DataFrame) -> DataFrame:
    """One row for each alert: its newest change. Changes without an id or a time are left out.

    Of changes at one instant the greatest verdict, then the greatest analyst
    counts, so order of arrival and repetition change nothing. The maximum
    combines before the shuffle: an alert with very many changes is one row per task.
    """
    order = F.struct("decided_at", "verdict", "analyst")
    return (
        changes.where(F.col("id").isNotNull() & F.col("decided_at").isNotNull())
        .groupBy("id")
        .agg(F.max(order).alias("last"))
        .select("id", "last.verdict", "last.analyst", "last.decided_at")
    )


def with_verdict(logs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Logs with the columns of their latest verdict, null without one; every log stays."""
    known = broadcast_if_small(latest_verdicts(verdicts))
    return logs.join(known, "id", "left")


def open_alerts(logs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Alerts not judged false positives; an alert judged otherwise later is open again."""
    dismissed = latest_verdicts(verdicts).where(F.col("verdict") == FALSE_POSITIVE).select("id")
    return logs.where("is_alert").join(broadcast_if_small(dismissed), "id", "left_anti")


@dataclass
class VerdictTable:
    """Verdict changes as they come, one folder for each load.

    A load keeps its newest change of each alert; writing a load again replaces
    it. Because the newest change wins wherever it stands, a late load with old
    verdicts changes nothing that is newer.
    """

    spark: SparkSession
    path: str

    def merge(self, changes: DataFrame, load: int) -> None:
        latest_verdicts(changes).write.mode("overwrite").parquet(f"{self.path}/load={load}")

    def read(self) -> DataFrame:
        stored = self.spark.read.schema(VERDICT_SCHEMA + ", load int").parquet(self.path)
        return latest_verdicts(stored)
