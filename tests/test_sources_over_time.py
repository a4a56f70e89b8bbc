"""Incidents, address ranges, features over windows, verdicts and attribution against plain Python."""

import ipaddress
import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from conftest import normal_frame
from pyspark.sql import functions as F

from logvane.operators import address_ranges, attribution, feedback, incidents, source_features
from logvane.operators.forest import depth_limit, mean_depths, mean_path, pack_forest
from logvane.plans import source_queries
from logvane.schema import FEATURE_COLUMNS
from logvane.streaming import live

START = datetime(2024, 3, 1, tzinfo=timezone.utc)
LOGS = "id bigint, created_at timestamp, source_ip string, event_type string, anomaly_score double, is_alert boolean"


def made_logs(rows=400, seed=5):
    draw = random.Random(seed)
    out = []
    for i in range(rows):
        source = "10.0.0.1" if i % 3 == 0 else draw.choice(["10.0.0.2", "10.0.0.3", "10.1.0.9", None, ""])
        at = START + timedelta(seconds=draw.choice([0, 900, 1800, draw.randint(0, 60_000)]), microseconds=draw.choice([0, 1]))
        score = draw.choice([None, 0.1, 0.3, 0.6, 0.9])
        kind = draw.choice(["PortScan", "Bot", "", None, "other"])
        out.append((i, at, source, kind, score, draw.random() < 0.7))
    return out


def incidents_by_hand(rows):
    times = defaultdict(list)
    for _, at, source, _, _, is_alert in rows:
        if source and is_alert:
            times[source].append(at)
    found = []
    for source, own in times.items():
        own.sort()
        start = last = own[0]
        count = 0
        for at in own:
            if at - last >= timedelta(seconds=900):
                found.append((source, start, last, count))
                start, count = at, 0
            last, count = at, count + 1
        found.append((source, start, last, count))
    return sorted(found)


def seen(df):
    utc = lambda t: t.replace(tzinfo=timezone.utc) if t.tzinfo is None else t
    columns = ("source_ip", "start_time", "end_time", "alerts")
    rows = df.select("source_ip", F.unix_micros("start_time").alias("s"), F.unix_micros("end_time").alias("e"), "alerts")
    at = lambda us: datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=us)
    assert utc and columns
    return sorted((r["source_ip"], at(r["s"]), at(r["e"]), r["alerts"]) for r in rows.collect())


def test_incidents_equal_plain_gaps(spark):
    rows = made_logs()
    assert seen(incidents.incidents(spark.createDataFrame(rows, LOGS).repartition(3))) == incidents_by_hand(rows)


def test_incident_of_one_gap_is_two_and_worst_tier_counts(spark):
    rows = [
        (1, START, "a", "Bot", 0.3, True),
        (2, START + timedelta(seconds=899), "a", "PortScan", 0.8, True),
        (3, START + timedelta(seconds=1799), "a", None, None, True),
        (4, START + timedelta(seconds=1800), "a", "Bot", 0.99, False),
    ]
    got = incidents.incidents(spark.createDataFrame(rows, LOGS)).orderBy("start_time").collect()
    assert [(r["alerts"], r["worst_severity"]) for r in got] == [(2, "critical"), (1, None)]
    assert list(got[0]["techniques"]) == ["Command & Scripting", "Network Service Scan"] and got[1]["techniques"] == []
    assert incidents.incidents(spark.createDataFrame([], LOGS)).collect() == []


def test_streamed_incidents_equal_the_batch(spark, tmp_path):
    """Several micro-batches in time order; a last log far behind closes everything before it."""
    rows = sorted(made_logs(), key=lambda r: r[1])
    end = (9999, START + timedelta(days=3), "10.9.9.9", "Bot", 0.9, True)
    for i in range(0, 400, 100):
        spark.createDataFrame(rows[i : i + 100], LOGS).coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    spark.createDataFrame([end], LOGS).coalesce(1).write.parquet(f"{tmp_path}/in/part=400")
    # Files arrive one at a time, in the order of their folders' times.
    import os
    from pathlib import Path

    for place, folder in enumerate(sorted(Path(f"{tmp_path}/in").glob("part=*"), key=lambda p: int(p.name[5:]))):
        for file in folder.glob("*.parquet"):
            os.utime(file, (1_700_000_000 + place * 60,) * 2)
    stream = spark.readStream.schema(LOGS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    closed = live.run_to_table(
        incidents.stream_incidents(stream, "10 minutes"), f"{tmp_path}/out", f"{tmp_path}/checkpoint", "append"
    )
    assert seen(closed) == incidents_by_hand(rows)


def test_longest_prefix_equals_the_library(spark):
    draw = random.Random(8)
    known = {}
    for i in range(300):
        length = draw.choice([0, 1, 4, 8, 9, 12, 16, 17, 20, 24, 25, 28, 31, 32])
        base = draw.choice(["10.0.0.0", "10.0.1.77", "192.168.3.200", "255.255.255.255", f"10.{draw.randint(0, 3)}.7.1"])
        net = ipaddress.ip_network(f"{base}/{length}", strict=False)
        known[net] = min(known.get(net, "z"), f"owner{i:03}")
    known.pop(ipaddress.ip_network("0.0.0.0/0"), None)
    ranges = [(str(n), o) for n, o in known.items()] + [(str(n), "zz") for n in list(known)[:20]]
    ranges += [("10.0.0.0/33", "bad"), ("10.0.0/8", "bad"), ("x", "bad"), (None, "bad"), ("10.0.0.0/8/9", "bad")]
    texts = [f"10.{draw.randint(0, 4)}.{draw.randint(0, 9)}.{draw.randint(0, 255)}" for _ in range(200)]
    texts += ["192.168.3.200", "255.255.255.255", "0.0.0.0", "10.0.0.256", "::1", "", None, "010.0.0.1", "10.0.0.1", "10.0.0.1"]
    logs = spark.createDataFrame(list(enumerate(texts)), "id int, source_ip string")
    prefixes = address_ranges.prefixes(spark.createDataFrame(ranges, "prefix string, owner string"), "prefix", "owner")
    result = address_ranges.with_owner(logs, prefixes)
    got = {r["id"]: (r["length"], r["owner"]) for r in result.collect()}
    assert len(got) == len(texts) == result.count()
    for i, text in enumerate(texts):
        try:
            address = ipaddress.IPv4Address(text)
        except (ipaddress.AddressValueError, TypeError):
            assert got[i] == (None, None), text
            continue
        holding = [n for n in known if address in n]
        best = max(holding, key=lambda n: n.prefixlen, default=None)
        assert got[i] == ((best.prefixlen, known[best]) if best else (None, None)), text
    assert "NestedLoop" not in result._jdf.queryExecution().toString()
    assert "Cartesian" not in result._jdf.queryExecution().toString()


CONNECTIONS = "source_ip string, destination_ip string, port bigint, event_time timestamp"


def made_connections(rows=5000):
    draw = random.Random(2)
    return [
        (
            "10.0.0.1" if i % 3 == 0 else f"10.0.0.{draw.randint(2, 6)}",
            f"192.168.0.{draw.randint(1, 40)}",
            draw.choice([None, draw.randint(0, 3000)]),
            START + timedelta(seconds=draw.randint(0, 7199)),
        )
        for i in range(rows)
    ]


def test_window_features_equal_sets(spark):
    rows = made_connections()
    want = defaultdict(lambda: [0, set(), set()])
    for source, destination, port, at in rows:
        entry = want[source, int((at - START).total_seconds()) // 300]
        entry[0] += 1
        entry[1] |= {port} - {None}
        entry[2].add(destination)
    base = int(START.timestamp())
    features = source_features.window_features(spark.createDataFrame(rows, CONNECTIONS).repartition(3))
    got = {
        (r["source_ip"], (r["s"] - base) // 300): (r["flows"], r["ports"], r["destinations"], r["flows_per_second"])
        for r in features.withColumn("s", F.unix_seconds("window_start")).collect()
    }
    assert got == {k: (n, len(p), len(d), n / 300) for k, (n, p, d) in want.items()}


def test_united_sketches_stay_within_their_error(spark):
    rows = made_connections()
    sketches = source_features.port_sketches(spark.createDataFrame(rows, CONNECTIONS))
    hours = F.floor(F.unix_seconds("start") / 3600).cast("bigint")
    got = source_features.united(sketches, hours, "source_ip").collect()
    assert len(got) == 12 and sum(r["flows"] for r in got) == len(rows)
    exact = defaultdict(set)
    for source, _, port, at in rows:
        exact[source, int(at.timestamp()) // 3600] |= {port} - {None}
    for r in got:
        n = len(exact[r["source_ip"], r["span"]])
        assert abs(r["ports"] - n) <= 4 * source_features.sketch_error() * n


def test_streamed_sketches_equal_stored_ones(spark, tmp_path):
    rows = made_connections(600) + [("10.9.9.9", "x", 1, START + timedelta(days=1))]
    spark.createDataFrame(rows, CONNECTIONS).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(CONNECTIONS).parquet(f"{tmp_path}/in")
    streamed = live.run_to_table(
        source_features.port_sketches(stream, watermark="1 minute"), f"{tmp_path}/out", f"{tmp_path}/c", "append"
    )
    batch = source_features.port_sketches(spark.read.parquet(f"{tmp_path}/in")).where("source_ip <> '10.9.9.9'")
    shown = lambda df: sorted(
        tuple(r) for r in df.select("source_ip", F.unix_seconds("start"), "flows", F.hll_sketch_estimate("sketch")).collect()
    )
    assert shown(streamed) == shown(batch)


def test_late_and_repeated_verdicts(spark, tmp_path):
    at = lambda h: START + timedelta(hours=h)
    table = feedback.VerdictTable(spark, f"{tmp_path}/verdicts")
    load = lambda rows: spark.createDataFrame(rows, feedback.VERDICT_SCHEMA)
    first = load([(1, "false_positive", 7, at(5)), (1, "confirmed", 7, at(4)), (2, "false_positive", 7, at(5)), (None, "x", 1, at(1))])
    table.merge(first, 0)
    table.merge(load([(1, "confirmed", 8, at(3)), (2, "confirmed", 8, at(6)), (3, "unclear", 8, None)]), 1)
    shown = lambda: sorted((r["id"], r["verdict"], r["analyst"]) for r in table.read().collect())
    want = [(1, "false_positive", 7), (2, "confirmed", 8)]
    assert shown() == want
    table.merge(first, 0)
    assert shown() == want
    logs = spark.createDataFrame([(i, START, "a", "Bot", 0.5, i != 4) for i in range(1, 5)], LOGS)
    assert sorted(r["id"] for r in feedback.open_alerts(logs, table.read()).collect()) == [2, 3]
    judged = feedback.with_verdict(logs, table.read())
    assert judged.count() == 4 and judged.where("verdict is null").count() == 2


def test_contributions_add_up_to_the_depth(spark, detector):
    forest = detector.forest
    values = np.vstack([normal_frame(60)[FEATURE_COLUMNS].to_numpy(), np.full((3, len(FEATURE_COLUMNS)), 40.0)])
    limit = depth_limit(forest.subsample)
    shares = attribution.contributions(attribution.pack_changes(forest.nodes, limit), values.T)
    depth = mean_depths(pack_forest(forest.nodes, limit), values.T)
    assert np.allclose(shares.sum(axis=0), depth - mean_path(forest.subsample))
    # A row that is far out in one feature only is isolated by it.
    odd = np.zeros((1, len(FEATURE_COLUMNS)))
    odd[0, 3] = 40.0
    own = attribution.contributions(attribution.pack_changes(forest.nodes, limit), odd.T)[:, 0]
    assert own.argmin() == 3
    frame = spark.createDataFrame(odd.tolist(), FEATURE_COLUMNS)
    column = attribution.attribution(forest, [F.col(f"`{c}`") for c in FEATURE_COLUMNS])
    row = frame.select(column.alias("s")).select(
        "s", attribution.top_contributions(list(FEATURE_COLUMNS), F.col("s"), 2).alias("top")
    ).first()
    assert np.allclose(row["s"], own)
    assert row["top"][0]["feature"] == FEATURE_COLUMNS[3]
    with pytest.raises(ValueError):
        attribution.attribution(forest, [F.lit(0.0)])


def test_every_query_here_has_sql():
    assert set(source_queries.QUERIES) == set(source_queries.ORACLE)
