import json
import uuid
from pathlib import Path

import pytest
from conftest import normal_frame
from pyspark.sql import functions as F

from logvane.operators import triage
from logvane.operators.scoring import score_feature_maps
from logvane.plans.training import recall_table, release, train
from logvane.schema import FEATURE_COLUMNS
from logvane.sources import release as rel
from logvane.sources.log_table import LogTable
from logvane.streaming import live


@pytest.fixture(scope="module")
def trained(spark):
    benign = normal_frame(1500, 1).assign(Label="BENIGN")
    attack = (normal_frame(300, 2) * 1.0).assign(Label=" DDoS")
    attack[FEATURE_COLUMNS] += 3
    attack["row"] += 5000
    flows = spark.createDataFrame(benign).unionByName(spark.createDataFrame(attack))
    return train(flows, ["row"])


def test_training_stays_within_its_budget(trained):
    m = trained.metrics
    assert m["fpr"] <= 0.05 and m["recall"] > 0.9
    assert trained.flag_rate == pytest.approx(0.01, abs=0.005)
    assert trained.benign_rows + trained.attack_rows == trained.evaluated.count()
    assert trained.attack_rows == 300
    row = recall_table(trained).first()
    assert (row["event_type"], row["rows"], row["recall"]) == ("DDoS", 300, m["recall"])


@pytest.fixture()
def released(spark, trained, tmp_path):
    path = str(tmp_path / "release")
    release(trained, path, "v1")
    return path


def test_release_round_trip_scores_identically(spark, trained, released):
    loaded, card = rel.load_verified(spark, released)
    assert card["artifact_version"] == "v1" and card["training"]["n_estimators"] == 100
    assert loaded.forest.threshold == trained.detector.forest.threshold
    assert loaded.forest.feature_names == FEATURE_COLUMNS
    maps = spark.createDataFrame([({c: float(i) for c in FEATURE_COLUMNS},) for i in range(6)], "features map<string,double>")
    scores = [
        [r["anomaly_score"] for r in score_feature_maps(maps, d).collect()]
        for d in (trained.detector, loaded)
    ]
    assert scores[0] == scores[1]


def test_verified_load_decision_table(spark, released, tmp_path):
    with pytest.raises(FileNotFoundError):
        rel.load_verified(spark, str(tmp_path / "nothing"))
    assert rel.detector_for_job(spark, str(tmp_path / "nothing")) is None
    with pytest.raises(RuntimeError):
        rel.detector_for_job(spark, str(tmp_path / "nothing"), model_required=True)

    part = next(Path(released, "forest_nodes").glob("part-*"))
    intact = part.read_bytes()
    part.write_bytes(intact[:-1] + bytes([intact[-1] ^ 1]))
    for checksum in Path(released, "forest_nodes").glob(".part-*.crc"):
        checksum.unlink()
    with pytest.raises(rel.ReleaseIntegrityError, match="modified"):
        rel.load_verified(spark, released)
    with pytest.raises(rel.ReleaseIntegrityError):
        rel.detector_for_job(spark, released)
    part.write_bytes(intact)
    assert rel.load_verified(spark, released)

    card = next(Path(released, "card").glob("part-*"))
    text = json.loads(card.read_text())
    for crc in Path(released, "card").glob(".part-*.crc"):
        crc.unlink()
    for broken in ("{", json.dumps({**text, "schema_version": 2}), json.dumps({**text, "artifacts": 1})):
        card.write_text(broken)
        with pytest.raises(rel.ReleaseIntegrityError):
            rel.load_verified(spark, released)


def test_partial_release_fails_closed(spark, trained, tmp_path):
    path = str(tmp_path / "partial")
    rel.save_model(spark, trained.detector, path)
    with pytest.raises(rel.ReleaseIntegrityError, match="card"):
        rel.load_verified(spark, path)
    with pytest.raises(FileNotFoundError):
        rel.load_model(spark, str(tmp_path / "nothing"))


def test_manifest_statuses(spark):
    actual = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "name string, sha256 string")
    recorded = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4")], "name string, sha256 string")
    got = {r["name"]: r["status"] for r in rel.manifest_mismatches(actual, recorded).collect()}
    assert got == {"a": "ok", "b": "modified", "c": "unrecorded", "d": "missing"}


def message(features, **extra):
    return json.dumps({"event_time": "2024-01-01T00:00:00Z", "source_ip": "10.0.0.9",
                       "event_type": "x", "features": features, **extra})


@pytest.mark.parametrize("with_model", [True, False])
def test_ingest_stream_scores_stores_publishes_and_quarantines(spark, detector, tmp_path, with_model):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    calm, loud = ({c: v for c in FEATURE_COLUMNS} for v in (0.0, 40.0))
    (inbox / "1.txt").write_text("\n".join([message(calm), message(loud), message(None), message({})]))
    table = LogTable(spark, f"s_{uuid.uuid4().hex}", str(tmp_path / "table"))

    def run():
        live.start_ingest(
            spark.readStream.text(str(inbox)),
            table,
            detector if with_model else None,
            str(tmp_path / "checkpoint"),
            str(tmp_path / "quarantine"),
            str(tmp_path / "published"),
            available_now=True,
        ).awaitTermination()

    run()
    (inbox / "2.txt").write_text("\n".join([message(loud, is_alert=False), message(loud), "oops"]))
    run()
    stored = table.read()
    assert stored.count() == 5 and stored.select("id").distinct().count() == 5
    assert stored.where("is_alert").count() == (2 if with_model else 0)
    assert stored.where("anomaly_score IS NOT NULL").count() == (3 if with_model else 0)
    rejected = spark.read.json(str(tmp_path / "quarantine")).collect()
    assert sorted(r["reasons"][0] for r in rejected) == ["not_an_object", "unknown:is_alert"]
    frames = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "published")).collect()]
    assert len(frames) == 5 and {f["type"] for f in frames} == {"log"}
    assert {f["data"]["severity"] for f in frames} == ({None, "critical"} if with_model else {None})
    assert all("raw_payload" not in f["data"] and "top_features" in f["data"] for f in frames)
    # A micro-batch that is run again replaces its own rows.
    rows = stored.drop("ingest_date", "writer", "load")
    second = spark.createDataFrame(rows.where(stored["load"] == 1).collect(), rows.schema)
    name = stored.first()["writer"]
    table.append(second, 1, name)
    assert table.read().count() == 5
    # Another writer's load of the same number adds to them.
    table.append(second, 1, "another")
    assert table.read().count() == 5 + second.count()


def test_live_lists_survive_restarts_and_seed_from_alerts(spark, tmp_path):
    def batch(start, n):
        return spark.range(start, start + n).select(
            "id",
            F.timestamp_micros(F.col("id") * 1_000_000).alias("created_at"),
            F.lit("10.0.0.1").alias("source_ip"),
            F.lit("x").alias("event_type"),
            F.lit(0.9).alias("anomaly_score"),
            (F.col("id") % 2 == 0).alias("is_alert"),
        )

    path = str(tmp_path / "lists")
    lists = live.LiveLists(spark, path)
    lists.seed(batch(0, 30))
    lists.merge(batch(100, 40), 0)
    assert lists.recent_logs().count() == 52
    again = live.LiveLists(spark, path)
    again.merge(batch(200, 30), 1)
    again.merge(batch(200, 30), 1)
    newest = [r["id"] for r in again.recent_logs().collect()]
    assert newest == [*range(229, 199, -1), *range(139, 109, -1)]
    alerts = [r["id"] for r in triage.recent_logs(again.recent_alerts(), 25).collect()]
    assert alerts == [*range(228, 198, -2), *range(138, 118, -2)]
    assert again.threat_index().first()["threat_index"] == 50
