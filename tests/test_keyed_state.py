"""Folded state: retries, changes, compaction and expiry; buckets in append mode."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from logvane.operators import activity
from logvane.streaming import board, buckets, live
from logvane.streaming.keyed_state import KeyedState, largest, total

START = datetime(2024, 3, 1, tzinfo=timezone.utc)
LOGS = (
    "id bigint, created_at timestamp, source_ip string, event_type string, anomaly_score double, is_alert boolean"
)


def logs(spark, rows):
    made = [(i, START + timedelta(seconds=s), source, "Bot", score, score is not None) for i, s, source, score in rows]
    return spark.createDataFrame(made, LOGS)


@pytest.fixture
def state(spark, tmp_path):
    return KeyedState(
        spark, f"{tmp_path}/state", ["source_ip"], [total("events", F.count("*")), largest("last_time", F.col("created_at"))]
    )


def events(frame):
    return {r["source_ip"]: r["events"] for r in frame.collect()}


def test_retried_batch_counts_once_and_only_changed_keys_are_written(spark, state, tmp_path):
    state.seed(logs(spark, [(1, 0, "a", None), (2, 1, "b", None)]))
    batch = logs(spark, [(3, 2, "a", None), (4, 3, "c", None)])
    state.add(batch, 0)
    state.add(batch, 0)
    assert events(state.read()) == {"a": 2, "b": 1, "c": 1}
    assert events(state.changes(0)) == {"a": 2, "c": 1}
    written = spark.read.parquet(f"{tmp_path}/state/versions/version=0")
    assert events(written) == {"a": 1, "c": 1}


def test_compaction_changes_nothing_and_can_be_repeated(spark, state):
    for batch in range(4):
        state.add(logs(spark, [(batch, batch, "a", None), (10 + batch, batch, f"s{batch}", None)]), batch)
    before = events(state.read())
    state.compact(2)
    assert events(state.read()) == before
    state.compact(2)
    state.compact(3)
    assert events(state.read()) == before
    state.add(logs(spark, [(50, 9, "a", None)]), 4)
    assert events(state.read())["a"] == before["a"] + 1


def test_silent_keys_expire(spark, tmp_path):
    state = board.source_state(spark, f"{tmp_path}/s", idle_seconds=60)
    state.add(logs(spark, [(1, 0, "old", 0.5), (2, 30, "kept", None)]), 0)
    state.add(logs(spark, [(3, 90, "new", 0.9)]), 1)
    assert events(state.read()) == {"kept": 1, "new": 1}
    state.compact(1)
    state.add(logs(spark, [(4, 100, "old", 0.1)]), 2)
    assert events(state.read()) == {"new": 1, "old": 1}
    with pytest.raises(ValueError):
        KeyedState(spark, f"{tmp_path}/t", ["source_ip"], [], clock="last_time")


def test_source_view_equals_the_batch_operator(spark, tmp_path):
    rows = [(i, i // 2, f"s{i % 3}", None if i % 4 == 0 else (i % 10) / 10) for i in range(60)]
    rows += [(61, 5, None, 0.5), (62, 5, "", 0.5), (63, 6, "nan", float("nan"))]
    frame = logs(spark, rows)
    state = board.source_state(spark, f"{tmp_path}/s")
    for batch, part in enumerate(frame.randomSplit([0.4, 0.6], 1)):
        state.add(board.from_sources(part), batch)
    key = lambda r: r["source_ip"]
    got = sorted(board.source_view(state.read()).collect(), key=key)
    assert [str(r) for r in got] == [str(r) for r in sorted(activity.source_ip_state(frame).collect(), key=key)]


def test_board_seeds_everything_from_the_top_alerts(spark, tmp_path):
    stored = logs(spark, [(i, i, f"s{i % 5}", i / 100) for i in range(40)])
    shown = board.LiveBoard(spark, f"{tmp_path}/board")
    shown.seed(stored)
    shown.merge(logs(spark, [(100, 100, "s9", None), (101, 101, "s9", 0.5)]), 0)
    assert shown.totals.read().first()["total_logs"] == 42
    assert events(shown.sources.read()) == {"s0": 2, "s1": 2, "s2": 2, "s3": 3, "s4": 3, "s9": 2}
    assert board.category_view(shown.categories).first()["alerts"] == 13
    assert sorted(r["id"] for r in shown.lists.recent_alerts().collect()) == [*range(28, 40), 101]
    assert board.overall_view(shown.categories).first()["mean_score"] == pytest.approx((sum(range(28, 40)) / 100 + 0.5) / 13)


def test_nan_scores_leave_means_finite(spark, tmp_path):
    frame = logs(spark, [(1, 0, "a", 0.4), (2, 1, "a", float("nan")), (3, 2, "a", float("inf"))])
    assert activity.mean_alert_score(frame).first()["mean_score"] == 0.4
    assert activity.kpi_history(frame).agg(F.max("mean_score")).first()[0] == pytest.approx(0.4)
    state = board.category_state(spark, f"{tmp_path}/c")
    state.add(board.alerts_by_kind(frame), 0)
    assert board.category_view(state).first()["mean_score"] == pytest.approx(0.4)


def test_buckets_are_written_once_without_copies_of_logs(spark, tmp_path):
    rows = [(i, s, "a", 0.5 if i % 2 else None) for i, s in enumerate([0, 1, 2, 3, 61, 62, 300, 4000])]
    for i in range(0, 8, 2):
        logs(spark, rows[i : i + 2]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(LOGS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    counted = buckets.stream_buckets(stream, "2 hours")
    stored = live.run_to_table(buckets.numbered(counted), f"{tmp_path}/out", f"{tmp_path}/c", "append")
    assert stored.count() == 0  # the watermark has passed nothing
    late = buckets.stream_buckets(stream, "0 seconds")
    assert "Expand" not in buckets.stream_minutes(late)._jdf.queryExecution().toString()
    base = int(START.timestamp()) // 3
    made = spark.createDataFrame([(base, 3, 1), (base + 1, 1, 1), (base + 20, 2, 1)], "bucket long, logs long, alerts long")
    last = {r["bucket"] - base: (r["logs"], r["alerts"]) for r in buckets.last_buckets(made, 22).collect()}
    assert len(last) == 22 and last[20] == (2, 1) and last[5] == (0, 0) and last[-1] == (0, 0)
    rate = {r["bucket"] - base: r["logs_per_minute"] for r in buckets.minute_rate(made).collect()}
    assert rate == {0: 3, 1: 4, 20: 3}
    assert buckets.last_buckets(made.limit(0)).count() == 0
