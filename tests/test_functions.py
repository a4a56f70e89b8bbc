import json
import math
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from logvane.functions import coerce, severity as sev
from logvane.operators.parsing import parse_flows
from logvane.schema import FEATURE_COLUMNS

NOW = datetime(2024, 1, 1, tzinfo=timezone.utc)


def one(spark, column, **values):
    kinds = {str: "string", float: "double", int: "bigint", bool: "boolean"}
    fields, row = [], []
    for name, value in values.items():
        kind = "string"
        if isinstance(value, tuple):
            value, kind = value
        elif value is not None:
            kind = kinds[type(value)]
        fields.append(f"{name} {kind}")
        row.append(value)
    return spark.createDataFrame([tuple(row)], ", ".join(fields)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "score, alert, tier",
    [
        (0.99, False, None),
        (None, True, None),
        (None, False, None),
        (math.nan, True, None),
        (0.0001, True, "low"),
        (0.2499, True, "low"),
        (0.25, True, "medium"),
        (0.4999, True, "medium"),
        (0.5, True, "high"),
        (0.7499, True, "high"),
        (0.75, True, "critical"),
        (1.0, True, "critical"),
    ],
)
def test_severity_boundaries(spark, score, alert, tier):
    got = one(spark, sev.severity(F.col("s"), F.col("a")), s=(score, "double"), a=alert)
    assert got == tier


def test_tier_ranges_are_contiguous_and_agree_with_severity(spark):
    ranges = [sev.score_range(t) for t in sev.SEVERITIES]
    assert ranges[0][0] == 0.0 and ranges[-1][1] is None
    assert all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))
    scores = [i / 200 for i in range(201)] + [math.nan]
    df = spark.createDataFrame([(s,) for s in scores], "s double")
    alert = F.lit(True)
    for tier in sev.SEVERITIES:
        in_range = df.where(sev.in_tier(tier, F.col("s"), alert)).count()
        assert in_range == df.where(sev.severity(F.col("s"), alert) == tier).count()


def test_unknown_tier_is_refused():
    with pytest.raises(ValueError):
        sev.score_range("unheard-of")


@pytest.mark.parametrize("index, label", [(0, "LOW"), (25, "ELEVATED"), (50, "HIGH"), (75, "CRITICAL")])
def test_threat_labels(spark, index, label):
    assert one(spark, sev.threat_label(F.col("i")), i=index) == label


def test_techniques_fold_case(spark):
    assert one(spark, sev.technique(F.col("e")), e="DoS Hulk") == "Exploitation"
    assert one(spark, sev.technique(F.col("e")), e="BENIGN") is None


def test_narrative_words(spark):
    top = F.array(
        F.struct(F.lit("A").alias("feature"), F.lit(4.1).alias("deviation")),
        F.struct(F.lit("B").alias("feature"), F.lit(-2.0).alias("deviation")),
    )
    text = one(
        spark,
        sev.narrative(F.col("s"), F.col("a"), top, F.col("e"), F.col("t")),
        s=0.5, a=True, e=None, t="high",
    )
    assert "A (+4.1σ) and B (-2σ)" in text and "Classified anomaly at high severity." in text
    assert "anomaly score of 0.500" in text


@pytest.mark.parametrize(
    "value, whole, real",
    [
        ("12", 12, 12.0), (" 12.9 ", 12, 12.9), ("-12.9", -12, -12.9), ("n/a", None, None),
        ("", None, None), (None, None, None), ("inf", None, None), ("-Infinity", None, None),
        ("NaN", None, None), ("1d", None, None), ("0x1p3", None, None), ("1e3", 1000, 1000.0),
    ],
)
def test_text_coercion(spark, value, whole, real):
    assert one(spark, coerce.finite_long(F.col("v"), text=True), v=(value, "string")) == whole
    assert one(spark, coerce.finite_double(F.col("v"), text=True), v=(value, "string")) == real


@pytest.mark.parametrize("value", [math.inf, -math.inf, math.nan, None])
def test_non_finite_doubles_are_null(spark, value):
    assert one(spark, coerce.finite_double(F.col("v")), v=(value, "double")) is None
    assert one(spark, coerce.finite_long(F.col("v")), v=(value, "double")) is None


def flow(spark, **overrides):
    row = {
        "Label": "BENIGN",
        "Flow Duration": 2_500_000.0,
        "Total Length of Fwd Packets": 100,
        "Total Length of Bwd Packets": 50,
        "Destination Port": 80,
        "Flow Bytes/s": 5.5,
        "Flow Packets/s": 1.5,
        **overrides,
    }
    kinds = {str: "string", float: "double", int: "bigint", type(None): "string"}
    schema = ", ".join(f"`{k}` {kinds[type(v)]}" for k, v in row.items())
    return spark.createDataFrame([tuple(row.values())], schema)


def parsed(spark, **overrides):
    return parse_flows(flow(spark, **overrides), F.lit(NOW)).first()


def test_flow_row_becomes_log_row(spark):
    row = parsed(spark)
    assert row["event_type"] == "BENIGN"
    assert row["bytes_transferred"] == 150
    assert row["duration_seconds"] == 2.5
    assert [row[c] for c in ("source_ip", "destination_ip", "protocol", "flag")] == [None] * 4
    assert row["features"] == {
        "Flow Duration": 2_500_000.0, "Flow Bytes/s": 5.5, "Flow Packets/s": 1.5,
    }
    assert not {"is_alert", "anomaly_score"} & set(row.asDict())


def test_labels_are_trimmed_and_blank_is_null(spark):
    assert parsed(spark, Label=" DoS Hulk\t")["event_type"] == "DoS Hulk"
    assert parsed(spark, Label="  ")["event_type"] is None
    assert parsed(spark, Label=None)["event_type"] is None


@pytest.mark.parametrize("bad", [math.inf, math.nan])
def test_non_finite_values_leave_features_and_payload(spark, bad):
    row = parsed(spark, **{"Flow Duration": bad, "Flow Bytes/s": bad})
    assert row["duration_seconds"] is None
    assert set(row["features"]) == {"Flow Packets/s"}
    payload = json.loads(row["raw_payload"])
    assert payload["Flow Bytes/s"] is None and payload["Destination Port"] == 80


def test_missing_bytes_count_as_zero(spark):
    row = parsed(spark, **{"Total Length of Fwd Packets": "n/a"})
    assert row["bytes_transferred"] == 50


def test_event_time_defaults_to_now(spark):
    row = parse_flows(flow(spark)).first()
    assert abs((datetime.now() - row["event_time"]).total_seconds()) < 86_400


def test_absent_feature_columns_are_left_out(spark):
    assert "Down/Up Ratio" in FEATURE_COLUMNS
    assert "Down/Up Ratio" not in parsed(spark)["features"]


def test_iso_text_leaves_out_a_zero_fraction(spark):
    whole = one(spark, coerce.iso8601(F.timestamp_micros(F.col("m"))), m=1_704_067_200_000_000)
    part = one(spark, coerce.iso8601(F.timestamp_micros(F.col("m"))), m=1_704_067_200_000_120)
    assert whole == "2024-01-01T00:00:00+00:00" and part == "2024-01-01T00:00:00.000120+00:00"
