"""Queries on incidents, address ranges, sources over time, feedback and running state, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logvane.operators.validation import parse_messages, replay_summary
from logvane.operators import address_ranges, attribution, feedback, incidents, source_features, triage
from logvane.plans import oracle
from logvane.plans.catalog import _event_stream, _shown, fixed_detector, fixed_forest, micros
from logvane.plans.oracle import (
    _SOURCE_STATE,
    _TECHNIQUE,
    _THREAT_LABEL,
    FLOWS,
    FOREST,
    LOGS,
    MESSAGES,
    SHOWN,
    _mean_path,
    _with,
)
from logvane.schema import FEATURE_COLUMNS
from logvane.session import materialize, scratch_path
from logvane.sources import driver_tables as tables
from logvane.sources.log_table import LogTable
from logvane.sources.release import load_verified, save_model, write_card
from logvane.streaming import board, buckets, live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

WATERMARK_MINUTES = 10
WATERMARK = f"{WATERMARK_MINUTES} minutes"
# Logs before this are stored before a stream starts.
CUT = datetime(2024, 1, 12, tzinfo=timezone.utc)


def query(sql: str | None):
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return register


# --- incidents -----------------------------------------------------------

# The watermark as the stream's last batch sets it, from the newest alert; Spark keeps milliseconds.
_PASSED = f"((SELECT max(epoch_ms(created_at)) FROM weighted WHERE is_alert) - {WATERMARK_MINUTES * 60_000}) * 1000"

_INCIDENTS = _with(LOGS, f"""steps AS (
  SELECT *, {_TECHNIQUE} AS technique,
    CASE WHEN epoch_us(created_at) - lag(epoch_us(created_at)) OVER (
      PARTITION BY source_ip ORDER BY created_at, id) < 900000000 THEN 0 ELSE 1 END AS new
  FROM weighted WHERE is_alert),
islands AS (SELECT *, sum(new) OVER (PARTITION BY source_ip ORDER BY created_at, id) AS number FROM steps),
incidents AS (
  SELECT source_ip, min(epoch_us(created_at)) AS start_us, max(epoch_us(created_at)) AS end_us,
    count(*) AS alerts, max(weight) AS weight,
    coalesce(string_agg(DISTINCT technique, '|' ORDER BY technique), '') AS techniques
  FROM islands GROUP BY source_ip, number)""") + """
SELECT source_ip || '@' || start_us AS incident_id, source_ip, start_us, end_us, alerts,
  CASE weight WHEN 100 THEN 'critical' WHEN 70 THEN 'high' WHEN 40 THEN 'medium' WHEN 20 THEN 'low' END
    AS worst_severity, techniques
FROM incidents"""


def _incident_rows(found: DataFrame) -> DataFrame:
    return found.select(
        "incident_id",
        "source_ip",
        micros("start_time", "start_us"),
        micros("end_time", "end_us"),
        "alerts",
        "worst_severity",
        F.array_join("techniques", "|").alias("techniques"),
    )


@query(_INCIDENTS)
def alert_incidents(spark, sf_dir):
    return _incident_rows(incidents.incidents(tables.log_entries(spark, sf_dir)))


@query(_INCIDENTS + f" WHERE end_us + 900000000 <= {_PASSED}")
def stream_incidents(spark, sf_dir):
    """Incidents of the stream that its watermark has closed, each written once."""
    folder = scratch_path(spark)
    logs = _event_stream(spark, sf_dir, tables.log_entries_of)
    closed = live.run_to_table(
        incidents.stream_incidents(logs, WATERMARK), f"{folder}/out", f"{folder}/checkpoint", "append"
    )
    return _incident_rows(closed)


# --- address ranges ------------------------------------------------------


@query(_with(LOGS, """numbered AS (
  SELECT c_name AS owner, CASE WHEN c_custkey % 97 = 0 THEN c_custkey % 20 ELSE 20 + c_custkey * 7 % 13 END AS length,
    10 * 16777216 + c_custkey * 37 % 512 // 256 * 256 + c_custkey * 37 % 256 AS address
  FROM customer),
ranges AS (
  SELECT address - address % (1::BIGINT << (32 - length)::INT) AS network, length, min(owner) AS owner
  FROM numbered GROUP BY 1, 2),
addressed AS (
  SELECT id, source_ip, split_part(source_ip, '.', 1)::BIGINT * 16777216 + split_part(source_ip, '.', 2)::BIGINT * 65536
    + split_part(source_ip, '.', 3)::BIGINT * 256 + split_part(source_ip, '.', 4)::BIGINT AS address
  FROM logs)""") + """
SELECT id, source_ip, arg_max(network, length) AS network, max(length) AS length, arg_max(owner, length) AS owner
FROM addressed LEFT JOIN ranges ON address >= network AND address < network + (1::BIGINT << (32 - length)::INT)
GROUP BY id, source_ip""")
def logs_with_owner(spark, sf_dir):
    """Every log with the narrowest address range that holds its source."""
    known = address_ranges.prefixes(tables.owned_prefixes(spark, sf_dir), "prefix", "owner")
    owned = address_ranges.with_owner(tables.log_entries(spark, sf_dir), known)
    return owned.select("id", "source_ip", "network", F.col("length").cast("bigint").alias("length"), "owner")


# --- sources over time ---------------------------------------------------

_CONNECTIONS = """
connections AS (
  SELECT '10.9.' || (l_suppkey // 256 % 256) || '.' || (l_suppkey % 256) AS source_ip,
    '192.168.0.' || (l_partkey * 7 % 200) AS destination_ip, l_partkey % 1024 AS port,
    1704067200 + (l_orderkey * 31 + l_linenumber::BIGINT * 7) % 86400 AS second
  FROM lineitem)
"""


@query(_with(_CONNECTIONS) + """
SELECT source_ip, second // 300 * 300 AS start, count(*) AS flows, round(count(*) / 300.0::DOUBLE, 9) AS rate,
  count(DISTINCT port) AS ports, count(DISTINCT destination_ip) AS destinations
FROM connections GROUP BY 1, 2""")
def source_window_features(spark, sf_dir):
    """Connection rate, ports and destinations of every source in every five minutes."""
    features = source_features.window_features(tables.connections(spark, sf_dir))
    return features.select(
        "source_ip",
        F.unix_seconds("window_start").alias("start"),
        "flows",
        F.round("flows_per_second", 9).alias("rate"),
        "ports",
        "destinations",
    )


@query(_with(_CONNECTIONS) + """
SELECT source_ip, second // 3600 AS hour, count(*) AS flows, count(DISTINCT port) AS ports, true AS near
FROM connections GROUP BY 1, 2""")
def source_hour_sketches(spark, sf_dir):
    """Stored one-minute sketches united to hours, beside the exact number of ports.

    ``near``: whether the estimate lies within four standard errors (or half a port) of it.
    """
    connections = tables.connections(spark, sf_dir)
    hour = F.floor(F.unix_seconds("start") / 3600).cast("bigint")
    sketches = materialize(source_features.port_sketches(connections))
    estimated = source_features.united(sketches, hour, "source_ip").withColumnRenamed("ports", "estimate")
    exact = source_features.window_features(connections, 3600).select(
        "source_ip", F.floor(F.unix_seconds("window_start") / 3600).cast("bigint").alias("span"), "ports"
    )
    error = F.greatest(F.lit(0.5), 4 * source_features.sketch_error() * F.col("ports"))
    both = estimated.join(exact, ["source_ip", "span"])
    return both.select(
        "source_ip",
        F.col("span").alias("hour"),
        "flows",
        "ports",
        (F.abs(F.col("estimate") - F.col("ports")) <= error).alias("near"),
    )


@query(_with(_CONNECTIONS, """features AS (
  SELECT source_ip, second // 300 * 300 AS start, count(*) AS flows, count(DISTINCT port) AS ports
  FROM connections GROUP BY 1, 2)""") + " SELECT * FROM features WHERE ports >= 3 AND ports >= 0.8 * flows")
def scanning_sources(spark, sf_dir):
    """Windows in which nearly every flow of a source goes to another port."""
    features = source_features.window_features(tables.connections(spark, sf_dir))
    found = source_features.scanning_sources(features, least_ports=3)
    return found.select("source_ip", F.unix_seconds("window_start").alias("start"), "flows", "ports")


# --- feedback ------------------------------------------------------------

_VERDICTS = """
changes AS (
  SELECT o_orderkey % 9000 AS id, o_custkey AS analyst, o_orderdate AS decided_at,
    CASE o_orderstatus WHEN 'F' THEN 'false_positive' WHEN 'O' THEN 'confirmed' ELSE 'unclear' END AS verdict
  FROM orders),
verdicts AS (
  SELECT * FROM changes
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY decided_at DESC, verdict DESC, analyst DESC) = 1)
"""


def _merged_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All changes through the table: the newer half first, the older late, and one load repeated."""
    changes = tables.verdict_changes(spark, sf_dir)
    table = feedback.VerdictTable(spark, scratch_path(spark))
    newer = F.col("decided_at") >= F.lit("1995-06-01").cast("timestamp")
    table.merge(changes.where(newer), 0)
    table.merge(changes.where(~newer), 1)
    table.merge(changes.where(newer), 0)
    return table.read()


@query(_with(LOGS, _VERDICTS) + """
SELECT tiered.id, severity, verdict, analyst, epoch_us(decided_at::TIMESTAMP) AS decided_us
FROM tiered LEFT JOIN verdicts USING (id) WHERE is_alert""")
def alert_verdicts(spark, sf_dir):
    """Every alert with its latest verdict, out of loads that came late and twice."""
    alerts = triage.with_severity(tables.log_entries(spark, sf_dir).where("is_alert"))
    judged = feedback.with_verdict(alerts, _merged_verdicts(spark, sf_dir))
    return judged.select("id", "severity", "verdict", "analyst", micros("decided_at", "decided_us"))


@query(_with(LOGS, _VERDICTS) + f"""
SELECT {SHOWN} FROM tiered WHERE is_alert AND id NOT IN (SELECT id FROM verdicts WHERE verdict = 'false_positive')
ORDER BY anomaly_score DESC NULLS LAST, tiered.created_at DESC, id DESC LIMIT 100""")
def top_open_alerts(spark, sf_dir):
    """The most anomalous alerts that no analyst's last word has dismissed."""
    verdicts = _merged_verdicts(spark, sf_dir)
    return _shown(triage.top_alerts(feedback.open_alerts(tables.log_entries(spark, sf_dir), verdicts)))


# --- attribution ---------------------------------------------------------


def _change(child: int, parent: int) -> str:
    return f"(1.0::DOUBLE + {_mean_path(child)} - {_mean_path(parent)})"


# What each split of the fixed forest changes, as nested conditions by feature.
_T0 = '"Total Fwd Packets" <= 40.5::DOUBLE'
_T1 = '"Fwd Packet Length Mean" <= 100.0::DOUBLE'
_ATTRIBUTION = {
    "Total Fwd Packets": f"CASE WHEN {_T0} THEN {_change(200, 256)} ELSE {_change(56, 256)} END",
    "Total Backward Packets": f"""CASE WHEN {_T0} THEN CASE WHEN "Total Backward Packets" <= 2.5::DOUBLE
      THEN {_change(70, 200)} ELSE {_change(130, 200)} END ELSE 0.0 END""",
    "Flow Duration": f"""CASE WHEN {_T0} AND "Total Backward Packets" > 2.5::DOUBLE THEN
      CASE WHEN "Flow Duration" <= 50000000.0::DOUBLE THEN {_change(60, 130)} ELSE {_change(70, 130)} END ELSE 0.0 END""",
    "Fwd Packet Length Mean": f"CASE WHEN {_T1} THEN {_change(90, 256)} ELSE {_change(166, 256)} END",
    "Fwd Packet Length Std": f"""CASE WHEN NOT {_T1} THEN CASE WHEN "Fwd Packet Length Std" <= 300.0::DOUBLE
      THEN {_change(120, 166)} ELSE {_change(46, 166)} END ELSE 0.0 END""",
    "Down/Up Ratio": f"""CASE WHEN NOT {_T1} AND "Fwd Packet Length Std" <= 300.0::DOUBLE THEN
      CASE WHEN "Down/Up Ratio" <= 0.25::DOUBLE THEN {_change(2, 120)} ELSE {_change(118, 120)} END ELSE 0.0 END""",
    "Init_Win_bytes_forward": f"""CASE WHEN "Init_Win_bytes_forward" <= 5000.0::DOUBLE
      THEN {_change(1, 256)} ELSE {_change(255, 256)} END""",
}


@query(_with(FLOWS, "shares AS (SELECT flow_id, " + ", ".join(
    f"{_ATTRIBUTION.get(c, '0.0')} / 3.0::DOUBLE AS c{i}" for i, c in enumerate(FEATURE_COLUMNS)
) + " FROM labelled)") + "SELECT flow_id, " + ", ".join(
    f"round(c{i}, 9) + 0.0 AS c{i}" for i in range(len(FEATURE_COLUMNS))
) + ", round(" + " + ".join(f"c{i}" for i in range(len(FEATURE_COLUMNS))) + ", 6) AS total FROM shares")
def fixed_forest_attribution(spark, sf_dir):
    """What every feature adds to the mean depth under the fixed forest; together the depth minus c."""
    forest = fixed_forest()
    flows = tables.flows(spark, sf_dir, spread_out=True)
    shares = attribution.attribution(forest, [F.col(f"`{c}`") for c in FEATURE_COLUMNS])
    explained = flows.select("flow_id", shares.alias("shares"))
    total = F.aggregate("shares", F.lit(0.0), lambda a, x: a + x)
    return explained.select(
        "flow_id",
        *[(F.round(F.col("shares")[i], 9) + F.lit(0.0)).alias(f"c{i}") for i in range(len(FEATURE_COLUMNS))],
        F.round(total, 6).alias("total"),
    )


# --- release and scored stream -------------------------------------------


@query(oracle.ORACLE["fixed_forest_scores"])
def released_forest_scores(spark, sf_dir):
    """The small forest saved with its card, verified by hash, loaded and applied."""
    path = scratch_path(spark)
    save_model(spark, fixed_detector(), path)
    write_card(spark, path, {"artifact_version": "fixed"})
    forest = load_verified(spark, path)[0].forest
    raw = [F.col(f"`{c}`") for c in FEATURE_COLUMNS]
    flows = tables.flows(spark, sf_dir, spread_out=True)
    scored = flows.select("flow_id", forest.decision(forest.normality(raw)).alias("decision"))
    score = forest.anomaly_score(F.col("decision"))
    return scored.select(
        "flow_id",
        F.round("decision", 9).alias("decision"),
        F.round(score, 9).alias("anomaly_score"),
        (F.col("decision") < 0).cast("int").alias("is_outlier"),
        (score >= forest.threshold).alias("is_alert"),
    )


@query(_with(MESSAGES) + """SELECT count(*) FILTER (reasons = '') AS success, count(*) FILTER (reasons <> '') AS failed,
  (SELECT string_agg(error, '; ' ORDER BY id) FROM (SELECT id, reasons || ': ' || value AS error
     FROM judged WHERE reasons <> '' ORDER BY id LIMIT 5) AS e) AS first_errors,
  round(count(*) / 86400.0::DOUBLE, 9) AS per_second
FROM judged""")
def replay_report(spark, sf_dir):
    """A day's replay: counts, the first rejections as they came, and messages a second."""
    parsed = parse_messages(tables.messages(spark, sf_dir))
    report = replay_summary(parsed, arrival="id", seconds=86_400.0)
    return report.withColumns(
        {"first_errors": F.array_join("first_errors", "; "), "per_second": F.round("per_second", 9)}
    )


@query(_with(LOGS) + "SELECT event_type, count(*) AS logs, count(DISTINCT id) AS ids, 1 AS parts FROM logs GROUP BY 1")
def compacted_log_table(spark, sf_dir):
    """Logs stored in many loads, every day but the last compacted; how many partitions a day then has at most."""
    logs = tables.log_entries(spark, sf_dir)
    table = LogTable(spark, f"compacted_{uuid.uuid4().hex}", scratch_path(spark)).create_if_absent()
    for load in range(4):
        table.append(logs.where(F.pmod(F.xxhash64("id"), F.lit(4)) == load), load)
    # One day at a time, as days end; the test events span a month.
    days = table.days()
    for day in days[:2]:
        table.compact(day)
    parts = max(sum(d == day for d, _, _ in table.partitions("")) for day in days[:2])
    return table.read().groupBy("event_type").agg(
        F.count("*").alias("logs"), F.count_distinct("id").alias("ids"), F.lit(parts).alias("parts")
    )


# What the detector sees of a message: two features, 1 for the others.
_MESSAGE_FEATURES = ", ".join(
    {"Flow Duration": "k::DOUBLE", "Total Fwd Packets": "3.0::DOUBLE"}.get(c, "1.0::DOUBLE") + f' AS "{c}"'
    for c in FEATURE_COLUMNS
)


@query(_with(
    MESSAGES,
    f"seen AS (SELECT judged.id, ip, kind, k_features, k <> 11 AS has, {_MESSAGE_FEATURES} FROM judged "
    "JOIN (SELECT id, k FROM numbered) AS n USING (id) WHERE reasons = '')",
    FOREST.replace("FROM labelled", "FROM seen"),
    "scored AS (SELECT *, 1.0 / (1.0 + exp(decision * 80.0::DOUBLE)) AS score FROM forest)",
) + """SELECT id, ip AS source_ip, kind AS event_type, CASE WHEN has THEN round(score, 9) END AS anomaly_score,
  has AND score >= 0.6 AS is_alert, 'log' AS published,
  CASE WHEN NOT has OR score < 0.6 THEN NULL WHEN score < 0.75 THEN 'high' ELSE 'critical' END AS severity
FROM scored""")
def stream_detector_logs(spark, sf_dir):
    """Messages through the scoring ingest stream; what it stores beside what it publishes."""
    folder = scratch_path(spark)
    table = LogTable(spark, f"scored_{uuid.uuid4().hex}", f"{folder}/table")
    live.start_ingest(
        _event_stream(spark, sf_dir, tables.messages_of),
        table,
        fixed_detector(),
        f"{folder}/checkpoint",
        f"{folder}/quarantine",
        f"{folder}/published",
        available_now=True,
    ).awaitTermination()
    frames = spark.read.text(f"{folder}/published").select(
        F.get_json_object("value", "$.type").alias("published"),
        F.get_json_object("value", "$.data.id").cast("bigint").alias("id"),
        F.get_json_object("value", "$.data.severity").alias("severity"),
    )
    stored = table.read().select(
        "id", "source_ip", "event_type", F.round("anomaly_score", 9).alias("anomaly_score"), "is_alert"
    )
    return stored.join(frames, "id", "full_outer")


# --- running state -------------------------------------------------------


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Logs stored before the stream starts, and the stream of those since."""
    stored = tables.log_entries(spark, sf_dir).where(F.col("created_at") < F.lit(CUT))
    since = _event_stream(spark, sf_dir, tables.log_entries_of).where(F.col("created_at") >= F.lit(CUT))
    return stored, since


@query(_with(LOGS) + """
SELECT count(*) AS total_logs, count(*) FILTER (is_alert) AS total_alerts,
  count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'medium') AS medium,
  count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'critical') AS critical FROM tiered""")
def board_totals(spark, sf_dir):
    """Totals of what was stored before a cut and streamed after it: every log counts once."""
    folder = scratch_path(spark)
    stored, since = _halves(spark, sf_dir)
    state = board.totals_state(spark, f"{folder}/totals")
    state.seed(stored)
    state.start(since, f"{folder}/checkpoint", available_now=True).awaitTermination()
    return state.read().drop("score_sum", "score_count")


@query(_with(LOGS) + _SOURCE_STATE)
def board_sources(spark, sf_dir):
    """State of every source: seeded before the cut, folded by key after it, and compacted."""
    folder = scratch_path(spark)
    stored, since = _halves(spark, sf_dir)
    state = board.source_state(spark, f"{folder}/sources")
    state.seed(board.from_sources(stored))
    state.compact(-1)
    state.start(board.from_sources(since), f"{folder}/checkpoint", available_now=True).awaitTermination()
    return board.source_view(state.read()).withColumn("last_time", F.unix_micros("last_time"))


@query(_with(LOGS) + f"""SELECT * FROM (
  SELECT coalesce(nullif(event_type, ''), 'Unknown') AS event_type, count(*) AS alerts,
    round(avg(anomaly_score), 9) AS mean_score, max({_TECHNIQUE}) AS technique
  FROM logs WHERE is_alert GROUP BY 1)""")
def board_categories(spark, sf_dir):
    folder = scratch_path(spark)
    stored, since = _halves(spark, sf_dir)
    state = board.category_state(spark, f"{folder}/categories")
    state.seed(board.alerts_by_kind(stored))
    state.start(board.alerts_by_kind(since), f"{folder}/checkpoint", available_now=True).awaitTermination()
    return board.category_view(state).withColumn("mean_score", F.round("mean_score", 9))


@query(_with(LOGS) + f"""SELECT round(avg(anomaly_score), 9) AS mean_score,
  string_agg(DISTINCT {_TECHNIQUE}, '|' ORDER BY {_TECHNIQUE}) AS techniques FROM logs WHERE is_alert""")
def board_overall(spark, sf_dir):
    """Mean score of all alerts and the set of techniques seen."""
    folder = scratch_path(spark)
    stored, since = _halves(spark, sf_dir)
    state = board.category_state(spark, f"{folder}/categories")
    state.seed(board.alerts_by_kind(stored))
    state.start(board.alerts_by_kind(since), f"{folder}/checkpoint", available_now=True).awaitTermination()
    return board.overall_view(state).select(
        F.round("mean_score", 9).alias("mean_score"), F.array_join("techniques", "|").alias("techniques")
    )


_CUT_SQL = f"TIMESTAMP '{CUT:%Y-%m-%d}'"
# What a board shows that was opened at the cut: the top alerts of before, and all logs since.
_SEEDED = f"""top AS (
  SELECT * FROM weighted WHERE is_alert AND created_at < {_CUT_SQL}
  ORDER BY anomaly_score DESC NULLS LAST, created_at DESC, id DESC LIMIT 12),
on_board AS (SELECT * FROM top UNION ALL SELECT * FROM weighted WHERE created_at >= {_CUT_SQL})"""


@query(_with(LOGS, _SEEDED, """newest AS (SELECT weight FROM on_board ORDER BY created_at DESC, id DESC LIMIT 40),
shown AS (SELECT id FROM on_board WHERE is_alert ORDER BY created_at DESC, id DESC LIMIT 25),
indexed AS (SELECT CAST(floor(avg(weight) + 0.5) AS INTEGER) AS threat_index FROM newest)""") + f"""
SELECT (SELECT count(*) FROM logs) AS total_logs, (SELECT sum(id) FROM shown)::BIGINT AS shown_alerts,
  (SELECT count(DISTINCT source_ip) FROM on_board) AS sources,
  (SELECT round(avg(anomaly_score), 9) FROM on_board WHERE is_alert) AS mean_score,
  (SELECT string_agg(DISTINCT {_TECHNIQUE}, '|' ORDER BY {_TECHNIQUE}) FROM on_board WHERE is_alert) AS techniques,
  threat_index, {_THREAT_LABEL.format('threat_index')} AS threat_label FROM indexed""")
def seeded_board(spark, sf_dir):
    """A board opened at the cut: all its figures from the stored top alerts and the stream since."""
    folder = scratch_path(spark)
    stored, since = _halves(spark, sf_dir)
    shown = board.LiveBoard(spark, f"{folder}/board")
    shown.seed(stored)
    shown.start(since, f"{folder}/checkpoint", available_now=True).awaitTermination()
    overall = board.overall_view(shown.categories)
    one = [
        shown.totals.read().select("total_logs"),
        shown.lists.recent_alerts().agg(F.sum("id").alias("shown_alerts")),
        shown.sources.read().agg(F.count("*").alias("sources")),
        overall.select(F.round("mean_score", 9).alias("mean_score"), F.array_join("techniques", "|").alias("techniques")),
        shown.lists.threat_index(),
    ]
    # Single rows, side by side.
    out = one[0]
    for other in one[1:]:
        out = out.withColumns({c: other.select(c).scalar() for c in other.columns})
    return out


# --- chained windows -----------------------------------------------------

_PASSED_LOGS = f"((SELECT max(epoch_ms(created_at)) FROM weighted) - {WATERMARK_MINUTES * 60_000}) * 1000"
_CLOSED = f"""closed AS (
  SELECT bucket, count(*) AS logs, count(*) FILTER (is_alert) AS alerts FROM weighted
  GROUP BY bucket HAVING (bucket + 1) * 3000000 <= {_PASSED_LOGS})"""


def _stored_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of the stream that its watermark has closed, each written once."""
    folder = scratch_path(spark)
    counted = buckets.stream_buckets(_event_stream(spark, sf_dir, tables.log_entries_of), WATERMARK)
    return live.run_to_table(buckets.numbered(counted), f"{folder}/out", f"{folder}/checkpoint", "append")


@query(_with(LOGS, _CLOSED) + "SELECT * FROM closed")
def stream_buckets(spark, sf_dir):
    return _stored_buckets(spark, sf_dir)


@query(_with(LOGS, _CLOSED, "last AS (SELECT max(bucket) AS b FROM closed)") + """
SELECT t.bucket, coalesce(logs, 0) AS logs, coalesce(alerts, 0) AS alerts
FROM (SELECT unnest(range((SELECT b FROM last) - 29, (SELECT b FROM last) + 1)) AS bucket) AS t
LEFT JOIN closed USING (bucket)""")
def stream_last_buckets(spark, sf_dir):
    """The last thirty closed buckets, those without a log as zeros."""
    return buckets.last_buckets(_stored_buckets(spark, sf_dir))


@query(_with(LOGS, _CLOSED) + """SELECT bucket, logs, CAST(sum(logs) OVER (
  ORDER BY bucket RANGE BETWEEN 19 PRECEDING AND CURRENT ROW) AS BIGINT) AS logs_per_minute FROM closed""")
def stream_minute_rate(spark, sf_dir):
    """The rate at every busy tick as a sum of twenty stored buckets."""
    return buckets.minute_rate(_stored_buckets(spark, sf_dir))


@query(_with(LOGS) + f"""SELECT bucket // 20 AS minute, count(*) AS logs, count(*) FILTER (is_alert) AS alerts,
  count(DISTINCT bucket) AS busy_buckets FROM weighted GROUP BY 1
HAVING (bucket // 20 + 1) * 60000000 <= {_PASSED_LOGS}""")
def stream_minutes(spark, sf_dir):
    """Minutes out of the buckets' windows, in one stream."""
    folder = scratch_path(spark)
    counted = buckets.stream_buckets(_event_stream(spark, sf_dir, tables.log_entries_of), WATERMARK)
    return live.run_to_table(
        buckets.stream_minutes(counted), f"{folder}/out", f"{folder}/checkpoint", "append"
    )
