import json
import uuid
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from logvane.operators import activity, triage
from logvane.operators.validation import parse_messages, replay_summary, split_messages
from logvane.schema import LOG_SCHEMA
from logvane.session import scratch_path
from logvane.sources.flow_files import (
    label_column,
    read_flow_csv,
    read_sample,
    write_sample,
)
from logvane.sources.log_table import LogTable, assign_ids

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def logs(spark, rows):
    """Rows of (id, seconds after the start, score, alert, source, event type)."""
    data = [
        (i, START + timedelta(seconds=at), START + timedelta(seconds=at), ip, None, None, kind,
         None, None, None, None, score, alert, [])
        for i, at, score, alert, ip, kind in rows
    ]
    return spark.createDataFrame(data, LOG_SCHEMA)


ROWS = [
    (1, 0, 0.1, False, "10.0.0.1", "BENIGN"),
    (2, 10, 0.3, True, "10.0.0.1", "PortScan"),
    (3, 10, 0.8, True, "10.0.0.2", "DDoS"),
    (4, 90_000, None, True, "10.0.0.1", ""),
    (5, 90_001, 0.5, True, None, None),
    (6, 180_000, 0.8, False, "10.0.0.2", "BENIGN"),
]


def ids(df):
    return [r["id"] for r in df.collect()]


def test_empty_table_has_zero_stats(spark):
    row = triage.stats_summary(logs(spark, [])).first().asDict()
    assert set(row.values()) == {0} and row["alert_rate"] == 0.0
    assert {"low", "medium", "high", "critical"} <= set(row)
    assert [r["alerts"] for r in triage.alerts_by_severity(logs(spark, [])).collect()] == [0] * 4
    assert activity.threat_index(logs(spark, [])).first()["threat_index"] == 0
    assert activity.kpi_history(logs(spark, [])).count() == 0
    assert activity.mean_alert_score(logs(spark, [])).first()["mean_score"] == 0.0


def test_stats_count_unscored_alerts_in_no_tier(spark):
    row = triage.stats_summary(logs(spark, ROWS)).first()
    assert (row["total_logs"], row["total_alerts"], row["alert_rate"]) == (6, 4, 0.6667)
    assert (row["low"], row["medium"], row["high"], row["critical"]) == (0, 1, 1, 1)


def test_order_and_paging(spark):
    df = logs(spark, ROWS)
    assert ids(triage.recent_logs(df, 10)) == [6, 5, 4, 3, 2, 1]
    assert ids(triage.recent_logs(df, 2, skip=3)) == [3, 2]
    assert ids(triage.top_alerts(df, 10)) == [3, 5, 2, 4]
    assert "raw_payload" not in triage.responses(df).columns


def test_filters_compose(spark):
    df = logs(spark, ROWS)
    assert ids(triage.filter_logs(df, is_alert=False)) == [1, 6]
    assert ids(triage.filter_logs(df, severity="critical")) == [3]
    assert ids(triage.filter_logs(df, severity="low")) == []
    assert ids(triage.filter_logs(df, source_ip="10.0.0.1", is_alert=True)) == [2, 4]
    window = triage.filter_logs(
        df, start_time=START + timedelta(seconds=10), end_time=START + timedelta(seconds=90_001)
    )
    assert ids(window) == [2, 3, 4]
    with pytest.raises(ValueError):
        triage.filter_logs(df, severity="unheard-of")


def test_search_and_live_switches(spark):
    df = logs(spark, ROWS)
    assert ids(triage.search_logs(df, " portSCAN ")) == [2]
    assert ids(triage.search_logs(df, "benign")) == [1, 4, 6]
    assert ids(triage.search_logs(df, "0.80")) == [3, 6]
    assert ids(triage.stream_filter(df, alerts_only=True)) == [2, 3, 5]
    assert ids(triage.stream_filter(df, "high")) == [5]


def test_score_of_exactly_one_is_critical_everywhere(spark):
    df = logs(spark, [(1, 0, 1.0, True, None, None)])
    assert triage.stats_summary(df).first()["critical"] == 1
    assert ids(triage.filter_logs(df, severity="critical")) == [1]


def test_live_aggregates(spark):
    df = logs(spark, ROWS)
    cats = {r["event_type"]: r["alerts"] for r in activity.category_counts(df).collect()}
    assert cats == {"PortScan": 1, "DDoS": 1, "Unknown": 2}
    state = {r["source_ip"]: r for r in activity.source_ip_state(df).collect()}
    assert state["10.0.0.1"]["events"] == 3 and state["10.0.0.1"]["last_event"] == ""
    assert state["10.0.0.1"]["last_severity"] == "medium"
    assert state["10.0.0.2"]["ever_alert"] and state["10.0.0.2"]["last_severity"] == "critical"
    assert set(state) == {"10.0.0.1", "10.0.0.2"}
    index = activity.threat_index(df).first()
    assert index["threat_index"] == round((0 + 40 + 100 + 0 + 70 + 0) / 6)
    cover = {r["technique"] for r in activity.technique_coverage(df).collect()}
    assert cover == {"Network Service Scan", "Exploitation"}
    now = START + timedelta(seconds=60)
    assert ids(activity.logs_in_trailing_minute(df, now)) == [2, 3]


def test_timeline_fills_empty_buckets(spark):
    df = logs(spark, ROWS)
    line = activity.alerts_timeline(df, now=START + timedelta(seconds=12)).collect()
    counts = [r["alerts"] for r in sorted(line, key=lambda r: r["bucket"])]
    assert len(counts) == 30 and counts[-2] == 2 and sum(counts) == 2
    history = sorted(
        activity.kpi_history(df, now=START + timedelta(seconds=90_003)).collect(),
        key=lambda r: r["bucket"],
    )
    assert len(history) == 40
    assert (history[0]["logs"], history[-1]["logs"], history[-1]["critical"]) == (3, 5, 1)


def test_filters_reach_the_scan_and_limits_need_no_full_sort(spark):
    path = scratch_path(spark)
    logs(spark, ROWS).write.parquet(path)
    df = spark.read.parquet(path)

    def plan(frame):
        return frame._jdf.queryExecution().executedPlan().toString()

    pushed = plan(triage.filter_logs(df, severity="high", source_ip="10.0.0.1"))
    assert "GreaterThanOrEqual(anomaly_score,0.5)" in pushed
    assert "EqualTo(source_ip,10.0.0.1)" in pushed
    assert "TakeOrderedAndProject" in plan(triage.top_alerts(df))
    assert "raw_payload" not in plan(triage.stats_summary(df)).split("ReadSchema")[1]
    assert "WindowGroupLimit" in plan(activity.threat_index_by_source(df))
    for frame in (activity.alerts_timeline(df), activity.kpi_history(df)):
        assert "CartesianProduct" not in plan(frame)


@pytest.fixture()
def table(spark):
    return LogTable(spark, f"t_{uuid.uuid4().hex}", scratch_path(spark)).create_if_absent()


def test_loading_twice_stores_once_and_old_days_are_pruned(spark, table):
    df = logs(spark, ROWS)
    table.append(df, load=1)
    table.append(df, load=1)
    table.append(logs(spark, [(9, 90_500, 0.2, False, None, None)]), load=2)
    assert table.create_if_absent().read().count() == 7
    assert table.days() == ["2024-01-03", "2024-01-02", "2024-01-01"]
    newest = table.newest_days(2)
    assert ids(triage.recent_logs(newest, 2)) == [6, 9]
    assert sorted(ids(newest)) == [4, 5, 6, 9]
    assert "PartitionFilters: [isnotnull(ingest_date" in newest._jdf.queryExecution().toString()


def test_assigned_ids_are_unique_and_grow_with_the_load(spark):
    df = logs(spark, ROWS * 50).drop("id").repartition(7)
    first, second = (
        sorted(r["id"] for r in assign_ids(df, load).collect()) for load in (0, 3)
    )
    assert first == list(range(300)) and second[0] == 3 << 38 and second[-1] == (3 << 38) + 299


def judged(spark, *messages):
    rows = [(i, m if isinstance(m, str) else json.dumps(m)) for i, m in enumerate(messages)]
    df = spark.createDataFrame(rows, "id int, value string")
    return {r["id"]: r for r in parse_messages(df).collect()}


GOOD = {"event_time": "2024-01-01T00:00:00+02:00", "source_ip": "10.0.0.1", "features": {"a": 1}}


def test_messages_are_typed_and_rejected_with_reasons(spark):
    cases = [
        (GOOD, []),
        ({k: v for k, v in GOOD.items() if k != "event_time"}, ["required:event_time"]),
        ({**GOOD, "event_time": None}, ["required:event_time"]),
        ({**GOOD, "event_time": "soon"}, ["type:event_time"]),
        ({**GOOD, "event_time": "2024-13-01"}, ["type:event_time"]),
        ({**GOOD, "event_time": 1704067200}, []),
        ({**GOOD, "event_time": 1704067200000}, []),
        ({**GOOD, "event_time": "1704067200"}, []),
        ({**GOOD, "is_alert": True}, ["unknown:is_alert"]),
        ({**GOOD, "anomaly_score": 0.1, "x": 1}, ["unknown:anomaly_score", "unknown:x"]),
        ({**GOOD, "source_ip": "1" * 46}, ["too_long:source_ip"]),
        ({**GOOD, "source_ip": "1" * 45}, []),
        ({**GOOD, "protocol": 6}, ["type:protocol"]),
        ({**GOOD, "flag": "f" * 17}, ["too_long:flag"]),
        ({**GOOD, "bytes_transferred": 1.5}, ["type:bytes_transferred"]),
        ({**GOOD, "bytes_transferred": 2.0}, []),
        ({**GOOD, "bytes_transferred": "12"}, []),
        ({**GOOD, "duration_seconds": "soon"}, ["type:duration_seconds"]),
        ({**GOOD, "features": {"a": "b"}}, ["type:features"]),
        ({**GOOD, "features": {"a": None}}, ["type:features"]),
        ({**GOOD, "features": [1]}, ["type:features"]),
        ({**GOOD, "features": None}, []),
        ("[1]", ["not_an_object"]),
        ("{broken", ["not_an_object"]),
    ]
    rows = judged(spark, *[m for m, _ in cases])
    for i, (message, reasons) in enumerate(cases):
        assert rows[i]["reasons"] == reasons, message
    assert rows[0]["event_time"] == datetime(2023, 12, 31, 22, 0)
    assert rows[0]["features"] == {"a": 1.0}
    assert rows[15]["bytes_transferred"] == 2
    instants = {rows[i]["event_time"] for i in (5, 6, 7)}
    assert instants == {datetime(2024, 1, 1)}


def test_split_keeps_every_message_on_one_side(spark):
    rows = [(0, json.dumps(GOOD)), (1, "oops"), (2, json.dumps({**GOOD, "is_alert": False}))]
    df = spark.createDataFrame(rows, "id int, value string")
    valid, rejected = split_messages(df)
    assert ids(valid) == [0] and sorted(ids(rejected)) == [1, 2]
    assert rejected.columns == ["id", "value", "reasons"]
    summary = replay_summary(parse_messages(df)).first()
    assert (summary["success"], summary["failed"], len(summary["first_errors"])) == (1, 2, 2)


def test_flow_csv_headers_are_stripped_and_checked(spark):
    path = scratch_path(spark)
    df = spark.createDataFrame([("1", "BENIGN"), ("Infinity", " Bot")], "` Flow Bytes/s` string, ` Label` string")
    df.write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    rows = read_flow_csv(spark, path)
    assert rows.columns == ["Flow Bytes/s", "Label", "file"]
    assert rows.count() == 2 and all(f["file"].endswith(".csv") for f in rows.select("file").collect())
    assert label_column([" Label "]) == " Label "
    with pytest.raises(ValueError):
        label_column(["x"])


def test_prepared_sample_round_trip(spark):
    path = scratch_path(spark)
    with pytest.raises(FileNotFoundError):
        read_sample(spark, path)
    write_sample(spark.createDataFrame([(1, "a")], "n int, Label string"), path)
    assert read_sample(spark, path).count() == 1
    write_sample(read_sample(spark, path), path + "-csv", "csv")
    assert read_sample(spark, path + "-csv", "csv").columns == ["n", "Label"]


def test_flow_files_are_read_by_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" Label, X, Y, X\nBENIGN,1,2,3\nDDoS,4,Infinity,6\n")
    (tmp_path / "b.csv").write_text("Y,Label\n7,Bot\n")
    rows = read_flow_csv(spark, str(tmp_path)).orderBy("Label").collect()
    got = [(r["Label"], r["X"], r["X.1"], r["Y"], r["file"]) for r in rows]
    assert got == [
        ("BENIGN", "1", "3", "2", "a.csv"),
        ("Bot", None, None, "7", "b.csv"),
        ("DDoS", "4", "6", "Infinity", "a.csv"),
    ]
    (tmp_path / "c.csv").write_text("Y,Lab\n8,Z\n")
    with pytest.raises(ValueError, match="c.csv"):
        read_flow_csv(spark, str(tmp_path))
