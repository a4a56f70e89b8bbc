"""Named queries over the test tables, one or more per operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logvane.functions.coerce import clean_label, column_number, iso8601, rounded
from logvane.functions.severity import (
    narrative,
    recommended_action,
    severity,
    severity_weight,
    threat_label,
)
from logvane.operators import activity, evaluation, sampling, threshold, triage
from logvane.operators.forest import IsolationForestModel, classify
from logvane.operators.parsing import parse_flows
from logvane.operators.scaler import (
    BaselineScaler,
    BaselineScalerModel,
    FeatureParams,
    class_feature_stats,
    clean_rows,
    long_deviations,
)
from logvane.operators.scoring import Detector, score_logs, with_top_deviations
from logvane.operators.validation import (
    parse_messages,
    replay_summary,
    split_messages,
)
from logvane.plans.training import recall_table, train
from logvane.schema import FEATURE_COLUMNS, LABEL_COLUMN, RESPONSE_COLUMNS, TOP_FEATURE_TYPE
from logvane.session import materialize, scratch_path
from logvane.sources import driver_tables as tables
from logvane.sources.flow_files import read_flow_csv
from logvane.sources.log_table import LogTable, assign_ids
from logvane.sources.release import file_manifest, manifest_mismatches
from logvane.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Bounds used by the filter queries, inside the span of the test events.
WINDOW_START = datetime(2024, 1, 5, tzinfo=timezone.utc)
WINDOW_END = datetime(2024, 1, 20, tzinfo=timezone.utc)
WATCHED_IP = "10.0.0.7"

# A small hand-made forest: (tree, node, feature, threshold, rows).
FIXED_NODES = [
    (0, 0, 7, 40.5, 256), (0, 1, 8, 2.5, 200), (0, 2, -1, None, 56),
    (0, 3, -1, None, 70), (0, 4, 0, 50000000.0, 130), (0, 9, -1, None, 60), (0, 10, -1, None, 70),
    (1, 0, 3, 100.0, 256), (1, 1, -1, None, 90), (1, 2, 4, 300.0, 166),
    (1, 5, 17, 0.25, 120), (1, 6, -1, None, 46), (1, 11, -1, None, 2), (1, 12, -1, None, 118),
    (2, 0, 15, 5000.0, 256), (2, 1, -1, None, 1), (2, 2, -1, None, 255),
]
FIXED_OFFSET = -0.5
FIXED_DEVIATION = 0.05


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def micros(name: str, alias: str | None = None) -> Column:
    return F.unix_micros(F.col(name)).alias(alias or f"{name}_us")


def _shown(logs: DataFrame, *more: str) -> DataFrame:
    """Response rows (and ``more`` columns) with times as epoch microseconds."""
    return triage.with_severity(logs.select(*RESPONSE_COLUMNS, *more)).withColumns(
        {"event_time": F.unix_micros("event_time"), "created_at": F.unix_micros("created_at")}
    )


def _benign(flows: DataFrame) -> DataFrame:
    return sampling.split_benign(flows)[0]


def flow_score() -> Column:
    """A deterministic score with many ties, for the queries on thresholds."""
    size = F.col("`Total Fwd Packets`") + F.col("`Down/Up Ratio`")
    return size / (size + F.lit(60.0))


def _labelled_scores(flows: DataFrame) -> DataFrame:
    benign, attack = sampling.split_benign(flows)
    return evaluation.evaluation_set(
        benign.select(flow_score().alias("anomaly_score"), F.col(LABEL_COLUMN)),
        attack.select(flow_score().alias("anomaly_score"), F.col(LABEL_COLUMN)),
    )


# --- stored logs ---------------------------------------------------------


@query
def stats_summary(spark, sf_dir):
    return triage.stats_summary(tables.log_entries(spark, sf_dir))


@query
def alerts_by_severity(spark, sf_dir):
    return triage.alerts_by_severity(tables.log_entries(spark, sf_dir))


@query
def recent_logs(spark, sf_dir):
    return _shown(triage.recent_logs(tables.log_entries(spark, sf_dir)))


@query
def recent_logs_page(spark, sf_dir):
    return _shown(triage.recent_logs(tables.log_entries(spark, sf_dir), limit=50, skip=120))


@query
def top_alerts(spark, sf_dir):
    return _shown(triage.top_alerts(tables.log_entries(spark, sf_dir)))


@query
def all_alerts_ranked_last(spark, sf_dir):
    """All alerts by rank, the unscored ones at the end."""
    return _shown(triage.ranked_alerts(tables.log_entries(spark, sf_dir)), "rank")


@query
def logs_filtered(spark, sf_dir):
    logs = triage.filter_logs(
        tables.log_entries(spark, sf_dir),
        source_ip=WATCHED_IP,
        is_alert=True,
        start_time=WINDOW_START,
        end_time=WINDOW_END,
    )
    return _shown(logs)


@query
def non_alerts(spark, sf_dir):
    return _shown(triage.filter_logs(tables.log_entries(spark, sf_dir), is_alert=False))


@query
def logs_by_severity(spark, sf_dir):
    return _shown(triage.filter_logs(tables.log_entries(spark, sf_dir), severity="high"))


@query
def critical_logs(spark, sf_dir):
    return _shown(triage.filter_logs(tables.log_entries(spark, sf_dir), severity="critical"))


@query
def log_search(spark, sf_dir):
    found = triage.search_logs(tables.log_entries(spark, sf_dir), "PortScan 10.0.0.1")
    return found.select("id", "event_type", "source_ip", "severity")


@query
def live_filter(spark, sf_dir):
    found = triage.stream_filter(tables.log_entries(spark, sf_dir), "medium", alerts_only=True)
    return found.select("id", "severity")


@query
def trailing_minute(spark, sf_dir):
    recent = activity.logs_in_trailing_minute(tables.log_entries(spark, sf_dir))
    return recent.select("id", micros("created_at"))


@query
def log_responses(spark, sf_dir):
    """Every stored log as it is served, times as ISO text."""
    served = triage.responses(tables.log_entries(spark, sf_dir))
    return served.withColumns(
        {"event_time": iso8601(F.col("event_time")), "created_at": iso8601(F.col("created_at"))}
    )


@query
def log_table_round_trip(spark, sf_dir):
    """Create the table, load it twice under one number, read the newest days."""
    logs = tables.log_entries(spark, sf_dir)
    name = f"logs_{uuid.uuid4().hex}"
    table = LogTable(spark, name, scratch_path(spark)).create_if_absent()
    table.append(logs, load=1)
    table.append(logs, load=1)
    return _shown(table.read())


@query
def two_writers_one_table(spark, sf_dir):
    """A bulk load and two streams' loads under one number, one of them written again."""
    logs = tables.log_entries(spark, sf_dir).drop("id")
    table = LogTable(spark, f"logs_{uuid.uuid4().hex}", scratch_path(spark)).create_if_absent()
    first, second = logs.where("is_alert"), logs.where("not is_alert")
    table.append(logs, load=1)
    table.append(first, load=1, writer="stream-a")
    table.append(first, load=1, writer="stream-a")
    table.append(second, load=1, writer="stream-b")
    stored = table.read()
    return stored.groupBy("event_type").agg(
        F.count("*").alias("logs"), F.count_distinct("writer", "id").alias("ids")
    )


@query
def assigned_ids(spark, sf_dir):
    """Ids given to rows without one: how many, and how far they spread."""
    numbered = assign_ids(tables.log_entries(spark, sf_dir).drop("id"), load=0)
    return numbered.agg(
        F.count("*").alias("logs"),
        F.count_distinct("id").alias("ids"),
        F.min("id").alias("first_id"),
        F.max("id").alias("last_id"),
    )


# --- live view -----------------------------------------------------------


@query
def category_counts(spark, sf_dir):
    return activity.category_counts(tables.log_entries(spark, sf_dir))


@query
def top_categories(spark, sf_dir):
    return activity.top_categories(tables.log_entries(spark, sf_dir))


@query
def mean_alert_score(spark, sf_dir):
    return activity.mean_alert_score(tables.log_entries(spark, sf_dir))


@query
def top_source_ips(spark, sf_dir):
    return activity.top_source_ips(tables.log_entries(spark, sf_dir))


@query
def source_ip_state(spark, sf_dir):
    state = activity.source_ip_state(tables.log_entries(spark, sf_dir))
    return state.withColumn("last_time", F.unix_micros("last_time"))


@query
def newest_alerts(spark, sf_dir):
    logs = tables.log_entries(spark, sf_dir).where("is_alert")
    return _shown(triage.recent_logs(logs, activity.RECENT_ALERTS))


@query
def threat_index(spark, sf_dir):
    return activity.threat_index(tables.log_entries(spark, sf_dir))


@query
def threat_index_by_source(spark, sf_dir):
    return activity.threat_index_by_source(tables.log_entries(spark, sf_dir))


@query
def threat_index_history(spark, sf_dir):
    history = activity.threat_index_history(tables.log_entries(spark, sf_dir))
    return history.select("id", "threat_index")


@query
def threat_index_source_history(spark, sf_dir):
    history = activity.threat_index_history(tables.log_entries(spark, sf_dir), by=("source_ip",))
    return history.select("source_ip", "id", "threat_index")


@query
def alerts_timeline(spark, sf_dir):
    return activity.alerts_timeline(tables.log_entries(spark, sf_dir))


@query
def logs_per_minute(spark, sf_dir):
    return activity.logs_per_minute(tables.log_entries(spark, sf_dir))


@query
def kpi_history(spark, sf_dir):
    history = activity.kpi_history(tables.log_entries(spark, sf_dir))
    return history.withColumns(
        {"alert_rate": F.round("alert_rate", 6), "mean_score": F.round("mean_score", 6)}
    )


@query
def severity_weight_actions(spark, sf_dir):
    logs = triage.with_severity(tables.log_entries(spark, sf_dir))
    weight = severity_weight(F.col("severity"))
    return logs.select(
        "id",
        "severity",
        weight.alias("weight"),
        threat_label(weight).alias("threat_label"),
        recommended_action(F.col("severity")).alias("action"),
    )


@query
def logs_with_technique(spark, sf_dir):
    return activity.with_technique(tables.log_entries(spark, sf_dir)).select("id", "technique")


@query
def technique_coverage(spark, sf_dir):
    return activity.technique_coverage(tables.log_entries(spark, sf_dir))


@query
def alert_narratives(spark, sf_dir):
    logs = triage.with_severity(tables.log_entries(spark, sf_dir))
    deviations = F.array(
        F.struct(F.lit("Flow Duration").alias("feature"), F.col("duration_seconds").alias("deviation")),
        F.struct(
            F.lit("Down/Up Ratio").alias("feature"),
            (-F.col("bytes_transferred")).cast("double").alias("deviation"),
        ),
        F.struct(F.lit("Flow IAT Std").alias("feature"), F.lit(0.0).alias("deviation")),
    )
    top = F.when(F.col("anomaly_score").isNotNull(), deviations).otherwise(F.array())
    return logs.select(
        "id",
        narrative(
            F.col("anomaly_score"), F.col("is_alert"), top, F.col("event_type"), F.col("severity")
        ).alias("narrative"),
    )


# --- parsing and validation ----------------------------------------------


@query
def parsed_flows(spark, sf_dir):
    logs = parse_flows(tables.flows(spark, sf_dir, spread_out=True), F.lit(WINDOW_START), keep=["flow_id"])
    return logs.select(
        "flow_id",
        micros("event_time"),
        "source_ip",
        "event_type",
        "bytes_transferred",
        F.round("duration_seconds", 6).alias("duration_seconds"),
    )


@query
def feature_map(spark, sf_dir):
    logs = parse_flows(tables.flows(spark, sf_dir, spread_out=True), F.lit(WINDOW_START), keep=["flow_id"])
    return logs.select(
        "flow_id",
        F.array_join(F.array_sort(F.map_keys("features")), "|").alias("names"),
        F.col("features")["Flow Bytes/s"].alias("bytes_rate"),
        F.col("features")["Flow Packets/s"].alias("packet_rate"),
        F.col("features")["Down/Up Ratio"].alias("ratio"),
    )


@query
def raw_payload_json(spark, sf_dir):
    logs = parse_flows(tables.flows(spark, sf_dir, spread_out=True), F.lit(WINDOW_START), keep=["flow_id"])
    payload = F.col("raw_payload")

    def number(name: str) -> Column:
        return F.get_json_object(payload, f"$['{name}']").try_cast("double")

    return logs.select(
        "flow_id",
        F.size(F.json_object_keys(payload)).alias("keys"),
        number("Flow Bytes/s").alias("bytes_rate"),
        number("Flow Packets/s").alias("packet_rate"),
        number("Flow Duration").alias("duration"),
        F.get_json_object(payload, "$.Label").alias("label"),
    )


@query
def quarantine(spark, sf_dir):
    _, rejected = split_messages(tables.messages(spark, sf_dir))
    return rejected.select("id", "value", F.array_join("reasons", ",").alias("reasons"))


@query
def accepted_messages(spark, sf_dir):
    accepted, _ = split_messages(tables.messages(spark, sf_dir))
    return accepted.select(
        "id",
        micros("event_time"),
        "source_ip",
        "event_type",
        "bytes_transferred",
        "duration_seconds",
        F.size("features").alias("features"),
        F.col("features")["Flow Duration"].alias("flow_duration"),
    )


@query
def ingest_counts(spark, sf_dir):
    summary = replay_summary(parse_messages(tables.messages(spark, sf_dir)))
    return summary.select(
        "success", "failed", F.array_join("first_errors", "; ").alias("first_errors")
    )


# --- sampling and splits -------------------------------------------------


@query
def label_counts(spark, sf_dir):
    return sampling.label_counts(tables.flows(spark, sf_dir))


@query
def label_distribution(spark, sf_dir):
    return sampling.label_distribution(tables.flows(spark, sf_dir))


@query
def sampling_fractions(spark, sf_dir):
    return sampling.sampling_fractions(tables.flows(spark, sf_dir)).withColumn(
        "fraction", F.round("fraction", 9)
    )


@query
def stratified_sample(spark, sf_dir):
    drawn = sampling.stratified_sample(tables.flows(spark, sf_dir, spread_out=True), tables.FLOW_IDS)
    return drawn.select("flow_id", "file", clean_label(F.col("Label")).alias("label"))


@query
def bernoulli_sample(spark, sf_dir):
    drawn = sampling.stratified_sample(tables.flows(spark, sf_dir), tables.FLOW_IDS, exact=False)
    return drawn.select("flow_id", "file", clean_label(F.col("Label")).alias("label"))


@query
def benign_split(spark, sf_dir):
    benign, attack = sampling.split_benign(tables.flows(spark, sf_dir))
    train_rows, test_rows = sampling.train_test_split(benign, tables.FLOW_IDS)
    parts = {"train": train_rows, "test": test_rows, "attack": attack}
    frames = [df.select("flow_id", F.lit(name).alias("part")) for name, df in parts.items()]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query
def replay_order(spark, sf_dir):
    return sampling.replay_order(tables.flows(spark, sf_dir), tables.FLOW_IDS, 5000).select(
        "flow_id", "file"
    )


@query
def flow_csv_source(spark, sf_dir):
    """Flows written as CSV with padded headers, read back and counted per label."""
    folder = scratch_path(spark)
    flows = tables.flows(spark, sf_dir).drop("file")
    flows.toDF(*[f" {c}" for c in flows.columns]).write.option("header", True).option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(folder)
    rows = read_flow_csv(spark, folder)
    return (
        rows.select(
            F.coalesce(clean_label(F.col("Label")), F.lit("")).alias("label"),
            column_number(rows, "Flow Bytes/s").alias("rate"),
            column_number(rows, "Total Length of Fwd Packets", whole=True).alias("bytes"),
        )
        .groupBy("label")
        .agg(
            F.count("*").alias("rows"),
            F.count("rate").alias("finite_rates"),
            F.sum("bytes").alias("bytes"),
        )
    )


# --- preprocessing -------------------------------------------------------


@query
def feature_params(spark, sf_dir):
    model = BaselineScaler().fit(_benign(tables.flows(spark, sf_dir, spread_out=True)))
    return model.params_frame(spark).select(
        "position",
        "feature",
        F.round("median", 6).alias("median"),
        F.round("mean", 3).alias("mean"),
        F.round("scale", 3).alias("scale"),
    )


@query
def clean_benign_rows(spark, sf_dir):
    clean = clean_rows(_benign(tables.flows(spark, sf_dir)), FEATURE_COLUMNS)
    return clean.agg(F.count("*").alias("rows"), F.round(F.sum("`Flow Bytes/s`"), 2).alias("rates"))


@query
def scaled_features(spark, sf_dir):
    flows = tables.flows(spark, sf_dir, spread_out=True)
    model = BaselineScaler().fit(_benign(flows))
    scaled = model.scaled({c: F.col(f"`{c}`") for c in model.columns})
    return flows.select("flow_id", *[rounded(z, 5).alias(f"z{i}") for i, z in enumerate(scaled)])


@query
def class_feature_summary(spark, sf_dir):
    flows = tables.flows(spark, sf_dir)
    attack = F.when(F.coalesce(clean_label(F.col("Label")) == "BENIGN", F.lit(False)), "benign")
    stats = class_feature_stats(
        flows.withColumn("class", attack.otherwise("attack")), FEATURE_COLUMNS, "class"
    )
    return stats.select(
        "class", "feature", F.round("mean", 3).alias("mean"), F.round("std", 3).alias("std")
    )


@query
def deviations_long(spark, sf_dir):
    """Mean absolute deviation from the benign baseline per label and feature."""
    flows = tables.flows(spark, sf_dir, spread_out=True)
    model = BaselineScaler().fit(_benign(flows))
    long = long_deviations(flows, model, ["Label"])
    label = F.coalesce(clean_label(F.col("Label")), F.lit(""))
    return long.groupBy(label.alias("label"), "feature").agg(
        F.round(F.avg(F.abs("deviation")), 5).alias("deviation")
    )


@query
def top_deviation_features(spark, sf_dir):
    flows = tables.flows(spark, sf_dir, spread_out=True)
    model = BaselineScaler().fit(_benign(flows))
    raw = {c: F.col(f"`{c}`") for c in model.columns}
    ranked = with_top_deviations(flows.select("flow_id", *raw.values()), model.columns, model.scaled(raw))
    return ranked.select("flow_id", F.posexplode("top_features").alias("place", "top")).select(
        "flow_id", (F.col("place") + 1).alias("place"), "top.feature", "top.deviation"
    )


# --- detection -----------------------------------------------------------


def fixed_forest(**settings) -> IsolationForestModel:
    nodes = pd.DataFrame(FIXED_NODES, columns=["tree", "node", "feature", "threshold", "rows"])
    return IsolationForestModel(
        nodes.astype({"threshold": float}),
        subsample=256,
        n_features=len(FEATURE_COLUMNS),
        offset=FIXED_OFFSET,
        deviation=FIXED_DEVIATION,
        **settings,
    )


def fixed_detector() -> Detector:
    """Values as they are, 1 where one is missing, and the small forest at a threshold of 0.6."""
    params = [FeatureParams(c, 1.0, 0.0, 1.0) for c in FEATURE_COLUMNS]
    return Detector(BaselineScalerModel(params), fixed_forest(threshold=0.6))


@query
def fixed_detector_logs(spark, sf_dir):
    """The production scorer on full, partial, empty and missing feature maps, with unknown keys."""
    flows = tables.flows(spark, sf_dir)
    pairs = [x for c in FEATURE_COLUMNS for x in (F.lit(c), F.col(f"`{c}`").cast("double"))]
    whole = F.create_map(*pairs, F.lit("unknown key"), F.lit(9e9))
    line = F.col("`Total Backward Packets`")
    features = (
        F.when(line == 1, F.lit(None))
        .when(line == 2, F.map_filter(whole, lambda k, v: F.lit(False)))
        .when(line == 3, F.map_filter(whole, lambda k, v: k != "Flow Duration"))
        .otherwise(whole)
    )
    scored = score_logs(flows.select("flow_id", features.alias("features")), fixed_detector())
    top = F.col("top_features")
    return scored.select(
        "flow_id",
        F.round("anomaly_score", 9).alias("anomaly_score"),
        "is_alert",
        severity(F.col("anomaly_score"), F.col("is_alert")).alias("severity"),
        F.array_join(top["feature"], "|").alias("top_features"),
    )


@query
def fixed_forest_scores(spark, sf_dir):
    """The scorer against a forest small enough to write out as SQL."""
    forest = fixed_forest()
    flows = tables.flows(spark, sf_dir, spread_out=True)
    raw = [F.col(f"`{c}`") for c in FEATURE_COLUMNS]
    scored = flows.select("flow_id", forest.decision(forest.normality(raw)).alias("decision"))
    score = forest.anomaly_score(F.col("decision"))
    return scored.select(
        "flow_id",
        F.round("decision", 9).alias("decision"),
        F.round(score, 9).alias("anomaly_score"),
        (F.col("decision") < 0).cast("int").alias("is_outlier"),
        classify(score, 0.6).alias("is_alert"),
    )


@query
def tuned_threshold(spark, sf_dir):
    scores = _labelled_scores(tables.flows(spark, sf_dir))
    best = threshold.tune_threshold(scores)
    # The tuned value, with the rates it gives on the same rows.
    flagged = scores.withColumn("prediction", classify(F.col("anomaly_score"), best).cast("int"))
    return evaluation.evaluate(flagged).select(
        F.round(F.lit(best), 12).alias("threshold"),
        F.round("recall", 9).alias("recall"),
        F.round("fpr", 9).alias("fpr"),
    )


@query
def roc_points(spark, sf_dir):
    curve = threshold.roc_curve(_labelled_scores(tables.flows(spark, sf_dir)))
    return curve.select(
        F.round("threshold", 12).alias("threshold"),
        "tp",
        "fp",
        F.round("tpr", 9).alias("tpr"),
        F.round("fpr", 9).alias("fpr"),
    )


@query
def confusion_metrics(spark, sf_dir):
    scores = _labelled_scores(tables.flows(spark, sf_dir))
    flagged = scores.withColumn("prediction", classify(F.col("anomaly_score"), 0.5).cast("int"))
    metrics = evaluation.evaluate(flagged)
    ratios = ("precision", "recall", "f1", "fpr", "adjusted_precision")
    return metrics.withColumns({c: F.round(c, 9) for c in ratios})


@query
def recall_by_label(spark, sf_dir):
    scores = _labelled_scores(tables.flows(spark, sf_dir)).where("is_attack = 1")
    flagged = scores.select(
        clean_label(F.col(LABEL_COLUMN)).alias("event_type"),
        classify(F.col("anomaly_score"), 0.5).cast("int").alias("prediction"),
    )
    return evaluation.recall_by_type(flagged).withColumn("recall", F.round("recall", 9))


@query
def self_flag_rate(spark, sf_dir):
    """Share of benign rows beyond a fixed forest's boundary."""
    benign = _benign(tables.flows(spark, sf_dir, spread_out=True))
    forest = fixed_forest()
    raw = [F.col(f"`{c}`") for c in FEATURE_COLUMNS]
    outlier = (forest.decision(forest.normality(raw)) < 0).cast("int")
    rate = evaluation.self_flag_rate(benign.select(outlier.alias("is_outlier")))
    return rate.select(F.round("self_flag_rate", 9).alias("self_flag_rate"))


@query
def trained_forest_scores(spark, sf_dir):
    """Train on the benign split; every flow with its score, whose walk training has already taken."""
    result = train(tables.flows(spark, sf_dir, spread_out=True), tables.FLOW_IDS)
    scored = result.detector.forest.judged(result.scored)
    return scored.select("flow_id", "decision", "anomaly_score", "is_outlier", "is_alert")


@query
def training_metrics(spark, sf_dir):
    result = train(tables.flows(spark, sf_dir, spread_out=True), tables.FLOW_IDS)
    return evaluation.evaluate(result.evaluated).select(
        F.lit(result.detector.forest.threshold).alias("threshold"),
        F.lit(result.flag_rate).alias("self_flag_rate"),
        *evaluation.METRIC_COLUMNS,
    )


@query
def training_recall(spark, sf_dir):
    return recall_table(train(tables.flows(spark, sf_dir, spread_out=True), tables.FLOW_IDS))


@query
def scored_logs(spark, sf_dir):
    """Raw flows to scored, explained and tiered logs in one plan."""
    flows = tables.flows(spark, sf_dir, spread_out=True)
    detector = train(flows, tables.FLOW_IDS).detector
    logs = score_logs(
        parse_flows(flows, F.lit(WINDOW_START), keep=["flow_id"]), detector
    )
    return logs.select(
        "flow_id",
        "event_type",
        "anomaly_score",
        "is_alert",
        severity(F.col("anomaly_score"), F.col("is_alert")).alias("severity"),
        F.to_json("top_features").alias("top_features"),
    )


@query
def unscored_logs(spark, sf_dir):
    """Without a detector every log is kept, unscored."""
    logs = parse_flows(tables.flows(spark, sf_dir, spread_out=True), F.lit(WINDOW_START), keep=["flow_id"])
    kept = score_logs(logs, None)
    return kept.select(
        "flow_id",
        "anomaly_score",
        "is_alert",
        severity(F.col("anomaly_score"), F.col("is_alert")).alias("severity"),
        F.size("top_features").alias("top_features"),
    )


@query
def manifest_check(spark, sf_dir):
    """Table files against a record with one hash changed, one name missing and one too many."""
    # Both sides of the comparison come from it; the files are read once.
    actual = materialize(file_manifest(spark, sf_dir, "*.parquet").select("name", "sha256"))
    changed = F.when(F.col("name") == "region.parquet", "0").otherwise(F.col("sha256"))
    recorded = actual.where("name <> 'part.parquet'").select("name", changed.alias("sha256"))
    gone = spark.range(1).select(F.lit("gone.parquet").alias("name"), F.lit("1").alias("sha256"))
    return manifest_mismatches(actual, recorded.unionByName(gone))


# --- streams -------------------------------------------------------------


def _event_stream(spark: SparkSession, sf_dir: str, view) -> DataFrame:
    """A view of ``events`` with the table read as a stream."""
    schema = tables.read_table(spark, sf_dir, "events").schema
    events = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir.rstrip("/"))
    )
    # One small file is one split; parsing it is shared among the cores.
    return view(events.repartition(spark.sparkContext.defaultParallelism, "event_id"))


def _drained(spark: SparkSession, query: DataFrame, mode: str = "complete") -> DataFrame:
    folder = scratch_path(spark)
    return live.run_to_table(query, f"{folder}/out", f"{folder}/checkpoint", mode)


@query
def stream_scored_logs(spark, sf_dir):
    """Messages through the ingest stream into the log table, unscored."""
    folder = scratch_path(spark)
    table = LogTable(spark, f"live_{uuid.uuid4().hex}", f"{folder}/table")
    running = live.start_ingest(
        _event_stream(spark, sf_dir, tables.messages_of),
        table,
        None,
        f"{folder}/checkpoint",
        f"{folder}/quarantine",
        f"{folder}/published",
        available_now=True,
    )
    running.awaitTermination()
    return table.read().select(
        "id",
        micros("event_time"),
        "source_ip",
        "event_type",
        "bytes_transferred",
        "is_alert",
        "anomaly_score",
    )


@query
def stream_totals(spark, sf_dir):
    logs = _event_stream(spark, sf_dir, tables.log_entries_of)
    totals = _drained(spark, live.stream_totals(logs))
    return live.seeded_totals(triage.stats_summary(tables.log_entries(spark, sf_dir)), totals)


@query
def stream_timeline(spark, sf_dir):
    logs = _event_stream(spark, sf_dir, tables.log_entries_of)
    return _drained(spark, live.stream_alert_timeline(logs))


@query
def stream_logs_per_minute(spark, sf_dir):
    logs = _event_stream(spark, sf_dir, tables.log_entries_of)
    return _drained(spark, live.stream_logs_per_minute(logs))


@query
def stream_source_state(spark, sf_dir):
    logs = _event_stream(spark, sf_dir, tables.log_entries_of)
    state = _drained(spark, live.stream_source_state(logs))
    return state.withColumn("last_time", F.unix_micros("last_time"))


@query
def stream_categories(spark, sf_dir):
    logs = _event_stream(spark, sf_dir, tables.log_entries_of)
    return _drained(spark, live.stream_categories(logs)).withColumn(
        "mean_score", F.round("mean_score", 9)
    )


@query
def stream_live_lists(spark, sf_dir):
    """Newest logs of a stream, kept across micro-batches."""
    folder = scratch_path(spark)
    lists = live.LiveLists(spark, f"{folder}/lists")
    logs = _event_stream(spark, sf_dir, tables.log_entries_of)
    lists.start(logs, f"{folder}/checkpoint", available_now=True).awaitTermination()
    return lists.recent_logs().select("id", micros("created_at"), "is_alert")


@query
def stream_threat_index(spark, sf_dir):
    folder = scratch_path(spark)
    lists = live.LiveLists(spark, f"{folder}/lists")
    logs = _event_stream(spark, sf_dir, tables.log_entries_of)
    lists.start(logs, f"{folder}/checkpoint", available_now=True).awaitTermination()
    return lists.threat_index()


@query
def live_frames(spark, sf_dir):
    """The JSON frame of every log, read back field by field."""
    logs = tables.log_entries(spark, sf_dir).withColumn(
        "top_features", F.array().cast(TOP_FEATURE_TYPE)
    )
    frames = live.live_frames(logs)
    data = F.from_json(
        F.get_json_object("value", "$.data"),
        "id bigint, source_ip string, event_type string, anomaly_score double, "
        "is_alert boolean, severity string, top_features array<struct<feature:string>>",
    )
    return frames.select(
        F.get_json_object("value", "$.type").alias("type"), data.alias("d")
    ).select(
        "type",
        "d.id",
        "d.source_ip",
        "d.event_type",
        F.round("d.anomaly_score", 9).alias("anomaly_score"),
        "d.is_alert",
        "d.severity",
        F.size("d.top_features").alias("top_features"),
    )
