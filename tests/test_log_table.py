"""Loads that replace themselves on any day, and compacted days."""

import uuid
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from logvane.operators.validation import parse_messages, replay_summary
from logvane.sources.log_table import LogTable

DAY = datetime(2024, 3, 1, 12, tzinfo=timezone.utc)
SCHEMA = "id bigint, created_at timestamp, event_type string, anomaly_score double, is_alert boolean"


@pytest.fixture
def table(spark, tmp_path):
    return LogTable(spark, f"t_{uuid.uuid4().hex}", f"{tmp_path}/table").create_if_absent()


def logs(spark, first, count, day=1, kind="a"):
    at = DAY.replace(day=day)
    return spark.createDataFrame([(first + i, at, kind, i / 100, True) for i in range(count)], SCHEMA)


def stored(table):
    return sorted((r["id"], r["event_type"]) for r in table.read().collect())


def test_a_load_repeated_on_another_day_replaces_itself(spark, table):
    table.append(logs(spark, 0, 5, day=1), 0)
    table.append(logs(spark, 10, 3, day=1), 1)
    table.append(logs(spark, 0, 5, day=1), 0, writer="o'ther")
    table.append(logs(spark, 0, 4, day=2, kind="b"), 0)
    assert stored(table) == sorted([(i, "b") for i in range(4)] + [(10 + i, "a") for i in range(3)] + [(i, "a") for i in range(5)])
    table.append(logs(spark, 0, 2, day=3), 0, writer="o'ther")
    assert table.read().where(F.col("writer") == "o'ther").count() == 2


def test_returned_rows_are_the_stored_ones(spark, table):
    given = table.append(logs(spark, 0, 4).drop("created_at", "id"), 0)
    key = lambda df: sorted((r["id"], str(r["created_at"])) for r in df.select("id", "created_at").collect())
    assert key(given) == key(table.read())


def test_compacted_days_keep_their_logs_in_one_partition(spark, table):
    for load in range(5):
        table.append(logs(spark, 10 * load, 6), load, writer="stream-a")
    table.append(logs(spark, 900, 2), 0)
    table.append(logs(spark, 500, 2, day=2), 5, writer="stream-a")
    before = stored(table)
    table.compact("2024-03-01", rows_per_file=10)
    assert stored(table) == before
    assert [p for p in table.partitions("ingest_date = '2024-03-01'")] == [
        ("2024-03-01", "bulk", -1), ("2024-03-01", "stream-a", -5),
    ]
    table.compact("2024-03-01")
    assert stored(table) == before
    # A late load of the day joins it at the next compaction; one that is in it can't come again.
    table.append(logs(spark, 700, 1), 6, writer="stream-a")
    table.compact("2024-03-01")
    assert len(stored(table)) == len(before) + 1
    with pytest.raises(ValueError, match="compacted"):
        table.append(logs(spark, 0, 1), 3, writer="stream-a")
    with pytest.raises(ValueError):
        table.append(logs(spark, 0, 1), -2)


def test_a_compaction_cut_short_is_finished_by_the_next(spark, table, monkeypatch):
    for load in range(3):
        table.append(logs(spark, 10 * load, 4), load)
    before = stored(table)
    monkeypatch.setattr(table, "_drop", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        table.compact("2024-03-01")
    monkeypatch.undo()
    table.compact("2024-03-01")
    assert stored(table) == before
    assert table.partitions("") == [("2024-03-01", "bulk", -3)]


def test_replay_in_arrival_order_and_repeated_keys(spark):
    rows = [(7, "z"), (1, "not json"), (2, '{"event_time": "2024-01-01", "event_time": "2024-01-02", "event_type": "x"}')]
    rows += [(3 + i, "b" * (9 - i)) for i in range(4)]
    parsed = parse_messages(spark.createDataFrame(rows, "id bigint, value string"))
    report = replay_summary(parsed, shown=3, arrival="id", seconds=2.0).first()
    assert (report["success"], report["failed"], report["per_second"]) == (1, 6, 3.5)
    assert [e.split(": ")[1][:3] for e in report["first_errors"]] == ["not", "bbb", "bbb"]
    assert replay_summary(parsed).first()["per_second"] is None
    accepted = parsed.where("size(reasons) = 0").select(F.date_format("event_time", "yyyy-MM-dd").alias("d")).first()
    assert accepted["d"] == "2024-01-02"
