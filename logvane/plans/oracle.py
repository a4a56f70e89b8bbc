"""The catalog's queries written independently as DuckDB SQL."""

from __future__ import annotations

from logvane.functions.severity import (
    DEFAULT_ACTION,
    NARRATIVE_ALERT,
    NARRATIVE_NO_FEATURES,
    NARRATIVE_NORMAL,
    RECOMMENDED_ACTIONS,
    TECHNIQUES,
)
from logvane.schema import FEATURE_COLUMNS

LOGS = """
logs AS (
  SELECT event_id AS id, ts AS event_time, ts AS created_at,
    '10.' || (user_id // 65536 % 256) || '.' || (user_id // 256 % 256) || '.' || (user_id % 256)
      AS source_ip,
    '192.168.0.' || (user_id % 256) AS destination_ip,
    CASE WHEN user_id % 2 = 0 THEN 'tcp' END AS protocol,
    CASE event_type WHEN 'click' THEN 'PortScan' WHEN 'purchase' THEN 'DoS Hulk'
      WHEN 'error' THEN 'SSH-Patator' WHEN 'view' THEN '' ELSE event_type END AS event_type,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS bytes_transferred,
    value AS duration_seconds,
    CAST(NULL AS VARCHAR) AS flag,
    CASE WHEN event_type <> 'signup' THEN value / (value + 100.0) END AS anomaly_score,
    CASE WHEN event_type = 'signup' THEN value >= 40.0
      ELSE value / (value + 100.0) >= 0.1 END AS is_alert
  FROM events
),
tiered AS (
  SELECT *, CASE WHEN NOT is_alert OR anomaly_score IS NULL THEN NULL
      WHEN anomaly_score >= 0.75 THEN 'critical' WHEN anomaly_score >= 0.5 THEN 'high'
      WHEN anomaly_score >= 0.25 THEN 'medium' ELSE 'low' END AS severity
  FROM logs
),
weighted AS (
  SELECT *, CASE severity WHEN 'critical' THEN 100 WHEN 'high' THEN 70 WHEN 'medium' THEN 40
      WHEN 'low' THEN 20 ELSE 0 END AS weight,
    CAST(floor(epoch_us(created_at) / 3000000) AS BIGINT) AS bucket
  FROM tiered
)
"""

SHOWN = """
  id, epoch_us(event_time) AS event_time, epoch_us(created_at) AS created_at, source_ip,
  destination_ip, protocol, event_type, bytes_transferred, duration_seconds, flag,
  anomaly_score, is_alert, severity
"""

_IS_FLOOD = "l_returnflag = 'R' AND l_linestatus = 'O'"
_BURST = f"CASE WHEN {_IS_FLOOD} AND l_discount >= 0.05 THEN 6.0::DOUBLE ELSE 1.0::DOUBLE END"

FLOWS = f"""
flows AS (
  SELECT
    l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-'
      || strftime(l_shipdate, '%Y%m%d') AS flow_id,
    'flows_' || strftime(l_shipdate, '%Y') || '.csv' AS file,
    CASE l_linenumber WHEN 3 THEN 'n/a' WHEN 5 THEN 'inf' ELSE CAST(l_partkey AS VARCHAR) END
      AS "Total Length of Fwd Packets",
    CASE WHEN l_tax = 0.08 THEN NULL ELSE CAST(l_suppkey AS VARCHAR) END
      AS "Total Length of Bwd Packets",
    l_extendedprice * 1000.0::DOUBLE AS "Flow Duration",
    CASE WHEN l_discount = 0.0 THEN 'inf'::DOUBLE
      ELSE l_extendedprice * ({_BURST}) / l_quantity END AS "Flow Bytes/s",
    CASE WHEN l_tax = 0.0 AND l_discount = 0.05 THEN 'nan'::DOUBLE
      ELSE l_quantity * (1.0::DOUBLE - l_discount) END AS "Flow Packets/s",
    l_extendedprice * l_discount * ({_BURST}) / l_quantity AS "Fwd Packet Length Mean",
    l_extendedprice * l_tax * ({_BURST}) / l_quantity AS "Fwd Packet Length Std",
    CAST(l_partkey % 1500 AS DOUBLE) AS "Bwd Packet Length Mean",
    CAST(l_suppkey % 97 AS DOUBLE) * l_tax AS "Bwd Packet Length Std",
    l_quantity * ({_BURST}) AS "Total Fwd Packets",
    CAST(l_linenumber AS DOUBLE) AS "Total Backward Packets",
    l_extendedprice / (l_quantity + CAST(l_linenumber AS DOUBLE)) AS "Flow IAT Mean",
    l_extendedprice * l_tax AS "Flow IAT Std",
    CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "SYN Flag Count",
    CASE WHEN l_returnflag = 'N' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "ACK Flag Count",
    CAST(l_linenumber % 2 AS DOUBLE) AS "RST Flag Count",
    CAST(l_partkey % 2 AS DOUBLE) AS "PSH Flag Count",
    CAST(l_orderkey % 65536 AS DOUBLE) AS "Init_Win_bytes_forward",
    CAST((l_orderkey * 7 + l_partkey) % 8192 AS DOUBLE) AS "Init_Win_bytes_backward",
    CAST(l_linenumber AS DOUBLE) / l_quantity AS "Down/Up Ratio",
    CASE WHEN {_IS_FLOOD} THEN 'DoS Hulk' WHEN l_returnflag = 'R' THEN ' PortScan'
      WHEN l_linenumber = 7 AND l_tax = 0.0 THEN '  ' WHEN l_linenumber = 1 THEN ' BENIGN '
      ELSE 'BENIGN' END AS raw_label
  FROM lineitem
),
labelled AS (
  SELECT *, nullif(trim(raw_label), '') AS label,
    coalesce(trim(raw_label) = 'BENIGN', false) AS is_benign
  FROM flows
)
"""


def _quoted(name: str) -> str:
    return f'"{name}"'


def _finite(name: str) -> str:
    return f"CASE WHEN isfinite({_quoted(name)}) THEN {_quoted(name)} END"


_ALL_FINITE = " AND ".join(f"isfinite({_quoted(c)})" for c in FEATURE_COLUMNS)

# One row per feature: medians, means and deviations on clean benign flows.
PARAMS = (
    f"clean AS (SELECT * FROM labelled WHERE is_benign AND {_ALL_FINITE}),\nparams AS ("
    + " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS feature, median({_quoted(c)}) AS median, "
        f"avg({_quoted(c)}) AS mean, "
        f"CASE WHEN stddev_pop({_quoted(c)}) > 0 THEN stddev_pop({_quoted(c)}) ELSE 1.0 END "
        f"AS scale FROM clean"
        for i, c in enumerate(FEATURE_COLUMNS)
    )
    + ")"
)

# Long form of every flow: one row per feature with its standard score.
LONG = (
    "raw AS ("
    + " UNION ALL ".join(
        f"SELECT flow_id, label, is_benign, {i} AS position, {_finite(c)} AS value FROM labelled"
        for i, c in enumerate(FEATURE_COLUMNS)
    )
    + """),
long AS (
  SELECT raw.*, feature, (coalesce(value, median) - mean) / scale AS z
  FROM raw JOIN params USING (position)
)"""
)

SCORES = """
scores AS (
  SELECT CASE WHEN is_benign THEN 0 ELSE 1 END AS y, label AS event_type,
    ("Total Fwd Packets" + "Down/Up Ratio")
      / ("Total Fwd Packets" + "Down/Up Ratio" + 60.0::DOUBLE) AS score
  FROM labelled
)
"""

CONFUSION = """
counts AS (
  SELECT count(*) FILTER (y = 1 AND flagged) AS tp, count(*) FILTER (y = 0 AND NOT flagged) AS tn,
    count(*) FILTER (y = 0 AND flagged) AS fp, count(*) FILTER (y = 1 AND NOT flagged) AS fn
  FROM predicted
),
rates AS (
  SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision,
    coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall,
    coalesce(fp / nullif(fp + tn, 0), 0.0) AS fpr
  FROM counts
)
"""

MESSAGES = """
numbered AS (
  SELECT event_id AS id, ts, user_id, event_type,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events
),
bodies AS (
  SELECT *, concat_ws(', ',
    CASE k WHEN 1 THEN NULL WHEN 2 THEN '"event_time": null' WHEN 3 THEN '"event_time": "yesterday"'
      ELSE '"event_time": "' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '"' END,
    CASE k WHEN 4 THEN '"source_ip": "' || repeat('9', 46) || '"' WHEN 5 THEN '"source_ip": 12'
      ELSE '"source_ip": "10.0.0.' || (user_id % 256) || '"' END,
    '"event_type": "' || event_type || '"',
    CASE k WHEN 6 THEN '"bytes_transferred": 1.5' WHEN 7 THEN '"bytes_transferred": "many"'
      WHEN 8 THEN '"bytes_transferred": null' ELSE '"bytes_transferred": ' || k END,
    '"duration_seconds": ' || k,
    CASE k WHEN 9 THEN '"features": {"Flow Duration": "slow"}' WHEN 10 THEN '"features": [1, 2]'
      WHEN 11 THEN '"features": {}'
      ELSE '"features": {"Flow Duration": ' || k || ', "Total Fwd Packets": 3, "other": 1.25}' END,
    CASE WHEN k = 12 THEN '"is_alert": true' END,
    CASE WHEN k IN (12, 13) THEN '"anomaly_score": 0.1' END) AS body
  FROM numbered
),
messages AS (
  SELECT *, CASE k WHEN 14 THEN '{' || body WHEN 15 THEN '[1, 2]' ELSE '{' || body || '}' END
    AS value
  FROM bodies
),
fields AS (
  SELECT id, value,
    coalesce(json_valid(value) AND json_type(CASE WHEN json_valid(value) THEN value END) = 'OBJECT',
      false) AS is_object,
    CASE WHEN json_valid(value) THEN value::JSON END AS doc
  FROM messages
),
kinds AS (
  SELECT *, nullif(json_type(doc, '$.event_time'), 'NULL') AS k_time,
    nullif(json_type(doc, '$.source_ip'), 'NULL') AS k_ip,
    nullif(json_type(doc, '$.event_type'), 'NULL') AS k_type,
    nullif(json_type(doc, '$.bytes_transferred'), 'NULL') AS k_bytes,
    nullif(json_type(doc, '$.features'), 'NULL') AS k_features,
    json_extract_string(doc, '$.event_time') AS time_text,
    json_extract_string(doc, '$.source_ip') AS ip,
    json_extract_string(doc, '$.event_type') AS kind,
    TRY_CAST(json_extract_string(doc, '$.bytes_transferred') AS DOUBLE) AS bytes
  FROM fields
),
judged AS (
  SELECT *, CASE WHEN NOT is_object THEN 'not_an_object' ELSE concat_ws(',',
    CASE WHEN k_time IS NULL THEN 'required:event_time' END,
    CASE WHEN k_time IS NOT NULL AND TRY_CAST(time_text AS TIMESTAMP) IS NULL
      THEN 'type:event_time' END,
    CASE WHEN k_ip IS NOT NULL AND k_ip <> 'VARCHAR' THEN 'type:source_ip' END,
    CASE WHEN k_type IS NOT NULL AND k_type <> 'VARCHAR' THEN 'type:event_type' END,
    CASE WHEN k_ip = 'VARCHAR' AND length(ip) > 45 THEN 'too_long:source_ip' END,
    CASE WHEN k_type = 'VARCHAR' AND length(kind) > 64 THEN 'too_long:event_type' END,
    CASE WHEN k_bytes IS NOT NULL AND (bytes IS NULL OR bytes <> floor(bytes))
      THEN 'type:bytes_transferred' END,
    CASE WHEN k_features IS NOT NULL AND (k_features <> 'OBJECT' OR EXISTS (
        SELECT 1 FROM (SELECT unnest(json_keys(doc, '$.features')) AS f) AS fs
        WHERE TRY_CAST(json_extract_string(doc, '$.features."' || f || '"') AS DOUBLE) IS NULL))
      THEN 'type:features' END,
    (SELECT string_agg('unknown:' || f, ',' ORDER BY f)
       FROM (SELECT unnest(json_keys(doc)) AS f) AS fs
       WHERE f NOT IN ('event_time', 'source_ip', 'destination_ip', 'protocol', 'event_type',
         'bytes_transferred', 'duration_seconds', 'flag', 'raw_payload', 'features'))) END
    AS reasons
  FROM kinds
)
"""

DIGEST = "md5('42|' || flow_id)"

SAMPLE = f"""
digests AS (
  SELECT flow_id, file, coalesce(label, '') AS label, {DIGEST} AS digest FROM labelled
),
sized AS (SELECT *, count(*) OVER (PARTITION BY file, label) AS n FROM digests),
strata AS (
  SELECT *, CASE WHEN label = 'BENIGN' THEN 0.02::DOUBLE
      ELSE greatest(0.02::DOUBLE, least(1.0::DOUBLE, 300.0::DOUBLE / n)) END AS fraction,
    row_number() OVER (PARTITION BY file, label ORDER BY digest) AS place
  FROM sized
)
"""


def _mean_path(rows: int) -> str:
    if rows <= 1:
        return "0.0::DOUBLE"
    if rows == 2:
        return "1.0::DOUBLE"
    return (
        f"(2.0::DOUBLE * (ln({rows - 1}::DOUBLE) + 0.5772156649015329::DOUBLE)"
        f" - 2.0::DOUBLE * {rows - 1} / {rows})"
    )


# The fixed forest's path lengths as nested conditions, one per tree.
_TREES = [
    f"""CASE WHEN "Total Fwd Packets" <= 40.5::DOUBLE THEN
      CASE WHEN "Total Backward Packets" <= 2.5::DOUBLE THEN 2 + {_mean_path(70)}
      ELSE CASE WHEN "Flow Duration" <= 50000000.0::DOUBLE THEN 3 + {_mean_path(60)}
        ELSE 3 + {_mean_path(70)} END END
    ELSE 1 + {_mean_path(56)} END""",
    f"""CASE WHEN "Fwd Packet Length Mean" <= 100.0::DOUBLE THEN 1 + {_mean_path(90)}
    ELSE CASE WHEN "Fwd Packet Length Std" <= 300.0::DOUBLE THEN
        CASE WHEN "Down/Up Ratio" <= 0.25::DOUBLE THEN 3 + {_mean_path(2)}
        ELSE 3 + {_mean_path(118)} END
      ELSE 2 + {_mean_path(46)} END END""",
    f"""CASE WHEN "Init_Win_bytes_forward" <= 5000.0::DOUBLE THEN 1 + {_mean_path(1)}
    ELSE 1 + {_mean_path(255)} END""",
]
FOREST = f"""
forest AS (
  SELECT *, -pow(2.0::DOUBLE, -(({' + '.join(f'({t})' for t in _TREES)}) / 3.0::DOUBLE)
    / {_mean_path(256)}) + 0.5::DOUBLE AS decision
  FROM labelled
)
"""


# What the fixed detector sees: 1 for what is not finite, and for the key that line 3 lacks.
IMPUTED = (
    "imputed AS (SELECT * REPLACE ("
    + ", ".join(
        f"coalesce(CASE WHEN {'true' if c != 'Flow Duration' else _quoted('Total Backward Packets') + ' <> 3'} "
        f"THEN {_finite(c)} END, 1.0::DOUBLE) AS {_quoted(c)}"
        for c in FEATURE_COLUMNS
    )
    + ") FROM labelled)"
)

# The five values farthest from 0 of each flow.
RANKED = (
    "values_of AS ("
    + " UNION ALL ".join(
        f"SELECT flow_id, {i} AS position, '{c}' AS feature, {_quoted(c)} AS z FROM imputed"
        for i, c in enumerate(FEATURE_COLUMNS)
    )
    + """),
placed AS (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY abs(z) DESC, position) AS place
  FROM values_of),
ranked AS (SELECT flow_id, string_agg(feature, '|' ORDER BY place) AS names
  FROM placed WHERE place <= 5 GROUP BY flow_id)"""
)


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


_TICK = "(SELECT max(bucket) FROM weighted)"

_SOURCE_STATE = """
SELECT source_ip, count(*) AS events, epoch_us(max(created_at)) AS last_time,
  arg_max_null(anomaly_score, (created_at, id)) AS last_score,
  arg_max_null(event_type, (created_at, id)) AS last_event,
  bool_or(is_alert) AS ever_alert,
  arg_max(severity, (created_at, id)) FILTER (severity IS NOT NULL) AS last_severity
FROM weighted GROUP BY source_ip
"""

_TIERS = """
  count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'medium') AS medium,
  count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'critical') AS critical
"""

_THREAT_LABEL = """CASE WHEN {0} >= 75 THEN 'CRITICAL' WHEN {0} >= 50 THEN 'HIGH'
  WHEN {0} >= 25 THEN 'ELEVATED' ELSE 'LOW' END"""



def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _said(sentence: str, *values: str) -> str:
    """A sentence of the narrative with its blanks filled."""
    parts = [_literal(x) for x in sentence.split("%s")]
    return " || ".join(x for pair in zip(parts, [*(f"({v})" for v in values), "''"]) for x in pair)


_ACTIONS = (
    "CASE severity "
    + " ".join(f"WHEN '{t}' THEN {_literal(RECOMMENDED_ACTIONS[t])}" for t in ("critical", "high", "medium"))
    + f" ELSE {_literal(DEFAULT_ACTION)} END"
)

_TECHNIQUE = (
    "CASE lower(event_type) "
    + " ".join(f"WHEN '{label}' THEN {_literal(name)}" for label, name in TECHNIQUES.items())
    + " END"
)

_TOTAL_BYTES = """
  coalesce(CASE WHEN isfinite(TRY_CAST("Total Length of Fwd Packets" AS DOUBLE))
    THEN CAST(trunc(TRY_CAST("Total Length of Fwd Packets" AS DOUBLE)) AS BIGINT) END, 0)
  + coalesce(CASE WHEN isfinite(TRY_CAST("Total Length of Bwd Packets" AS DOUBLE))
    THEN CAST(trunc(TRY_CAST("Total Length of Bwd Packets" AS DOUBLE)) AS BIGINT) END, 0)
"""

_SORTED_NAMES = sorted(FEATURE_COLUMNS)
_FEATURE_NAMES = "concat_ws('|', " + ", ".join(
    f"CASE WHEN isfinite({_quoted(c)}) THEN '{c}' END" for c in _SORTED_NAMES
) + ")"

_ISO = """strftime({0}, '%Y-%m-%dT%H:%M:%S')
  || CASE WHEN epoch_us({0}) % 1000000 = 0 THEN '' ELSE '.' || strftime({0}, '%f') END || '+00:00'"""

_PER_CLASS = " UNION ALL ".join(
    f"SELECT class, '{c}' AS feature, avg({_finite(c)}) AS mean, "
    f"stddev_pop({_finite(c)}) AS std FROM classed GROUP BY class"
    for c in FEATURE_COLUMNS
)

ORACLE: dict[str, str] = {
    "stats_summary": _with(LOGS) + f"""
SELECT count(*) AS total_logs, count(*) FILTER (is_alert) AS total_alerts,
  coalesce(round(count(*) FILTER (is_alert) / nullif(count(*), 0), 4), 0.0) AS alert_rate, {_TIERS}
FROM tiered""",
    "alerts_by_severity": _with(LOGS) + """
SELECT t.severity, count(tiered.id) AS alerts
FROM (VALUES ('low'), ('medium'), ('high'), ('critical')) AS t(severity)
LEFT JOIN tiered ON tiered.severity = t.severity GROUP BY t.severity""",
    "recent_logs": _with(LOGS) + f"SELECT {SHOWN} FROM tiered ORDER BY tiered.created_at DESC, id DESC LIMIT 100",
    "recent_logs_page": _with(LOGS)
    + f"SELECT {SHOWN} FROM tiered ORDER BY tiered.created_at DESC, id DESC LIMIT 50 OFFSET 120",
    "top_alerts": _with(LOGS) + f"""SELECT {SHOWN} FROM tiered WHERE is_alert
ORDER BY anomaly_score DESC NULLS LAST, tiered.created_at DESC, id DESC LIMIT 100""",
    "all_alerts_ranked_last": _with(LOGS) + f"""SELECT {SHOWN}, row_number() OVER (
  ORDER BY anomaly_score DESC NULLS LAST, tiered.created_at DESC, id DESC) AS rank
FROM tiered WHERE is_alert""",
    "logs_filtered": _with(LOGS) + f"""SELECT {SHOWN} FROM tiered
WHERE source_ip = '10.0.0.7' AND is_alert AND tiered.created_at >= TIMESTAMP '2024-01-05'
  AND tiered.created_at < TIMESTAMP '2024-01-20'""",
    "non_alerts": _with(LOGS) + f"SELECT {SHOWN} FROM tiered WHERE NOT is_alert",
    "logs_by_severity": _with(LOGS) + f"SELECT {SHOWN} FROM tiered WHERE severity = 'high'",
    "critical_logs": _with(LOGS) + f"SELECT {SHOWN} FROM tiered WHERE severity = 'critical'",
    "log_search": _with(LOGS) + """SELECT id, event_type, source_ip, severity FROM tiered
WHERE contains(lower(event_type || ' ' || source_ip), 'portscan 10.0.0.1')""",
    "live_filter": _with(LOGS) + "SELECT id, severity FROM tiered WHERE severity = 'medium'",
    "trailing_minute": _with(LOGS) + """SELECT id, epoch_us(created_at) AS created_at_us FROM logs
WHERE created_at > (SELECT max(created_at) FROM logs) - INTERVAL 60 SECOND""",
    "log_responses": _with(LOGS) + f"""SELECT id, {_ISO.format('event_time')} AS event_time,
  {_ISO.format('created_at')} AS created_at, source_ip, destination_ip, protocol, event_type,
  bytes_transferred, duration_seconds, flag, anomaly_score, is_alert, severity FROM tiered""",
    "log_table_round_trip": _with(LOGS) + f"SELECT {SHOWN} FROM tiered",
    "two_writers_one_table": _with(LOGS) + """SELECT event_type, 2 * count(*) AS logs,
  2 * count(*) AS ids FROM logs GROUP BY event_type""",
    # The same files at every scale factor.
    "manifest_check": """SELECT name, CASE name WHEN 'region.parquet' THEN 'modified'
  WHEN 'part.parquet' THEN 'unrecorded' WHEN 'gone.parquet' THEN 'missing' ELSE 'ok' END AS status
FROM (SELECT parse_filename(file) AS name FROM glob('/root/testdata/sf0.01/*.parquet')
  UNION ALL SELECT 'gone.parquet')""",
    "assigned_ids": """SELECT count(*) AS logs, count(*) AS ids, 0 AS first_id,
  count(*) - 1 AS last_id FROM events""",
    "category_counts": _with(LOGS) + """
SELECT coalesce(nullif(event_type, ''), 'Unknown') AS event_type, count(*) AS alerts
FROM logs WHERE is_alert GROUP BY 1""",
    "top_categories": _with(LOGS) + """
SELECT coalesce(nullif(event_type, ''), 'Unknown') AS event_type, count(*) AS alerts
FROM logs WHERE is_alert GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6""",
    "mean_alert_score": _with(LOGS) + """SELECT coalesce(round(avg(anomaly_score), 2), 0.0) AS mean_score,
  count(anomaly_score) AS scored_alerts FROM logs WHERE is_alert""",
    "top_source_ips": _with(LOGS) + """SELECT source_ip, count(*) AS events,
  bool_or(is_alert) AS ever_alert FROM logs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6""",
    "source_ip_state": _with(LOGS) + _SOURCE_STATE,
    "newest_alerts": _with(LOGS)
    + f"SELECT {SHOWN} FROM tiered WHERE is_alert ORDER BY tiered.created_at DESC, id DESC LIMIT 25",
    "threat_index": _with(LOGS, """newest AS (
  SELECT weight FROM weighted ORDER BY created_at DESC, id DESC LIMIT 40),
indexed AS (SELECT CAST(floor(avg(weight) + 0.5) AS INTEGER) AS threat_index FROM newest)""") + f"""
SELECT threat_index, {_THREAT_LABEL.format('threat_index')} AS threat_label FROM indexed""",
    "threat_index_by_source": _with(LOGS, """ranked AS (
  SELECT source_ip, weight,
    row_number() OVER (PARTITION BY source_ip ORDER BY created_at DESC, id DESC) AS place
  FROM weighted),
indexed AS (SELECT source_ip, CAST(floor(avg(weight) + 0.5) AS INTEGER) AS threat_index
  FROM ranked WHERE place <= 40 GROUP BY source_ip)""") + f"""
SELECT source_ip, threat_index, {_THREAT_LABEL.format('threat_index')} AS threat_label
FROM indexed""",
    "threat_index_history": _with(LOGS) + """SELECT id, CAST(floor(avg(weight) OVER (
  ORDER BY created_at, id ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) + 0.5) AS INTEGER)
  AS threat_index FROM weighted""",
    "threat_index_source_history": _with(LOGS) + """SELECT source_ip, id, CAST(floor(avg(weight) OVER (
  PARTITION BY source_ip ORDER BY created_at, id ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) + 0.5)
  AS INTEGER) AS threat_index FROM weighted""",
    "alerts_timeline": _with(LOGS) + f"""
SELECT t.bucket, count(weighted.id) AS alerts
FROM (SELECT unnest(range({_TICK} - 29, {_TICK} + 1)) AS bucket) AS t
LEFT JOIN weighted ON weighted.bucket = t.bucket AND is_alert GROUP BY t.bucket""",
    "logs_per_minute": _with(LOGS, "counts AS (SELECT bucket, count(*) AS logs FROM weighted GROUP BY bucket)") + """
SELECT bucket, logs, CAST(sum(logs) OVER (ORDER BY bucket RANGE BETWEEN 19 PRECEDING AND CURRENT ROW)
  AS BIGINT) AS logs_per_minute FROM counts""",
    "kpi_history": _with(LOGS, f"ticks AS (SELECT unnest(range({_TICK} - 39, {_TICK} + 1)) AS bucket)") + """
SELECT ticks.bucket, count(*) AS logs, count(*) FILTER (is_alert) AS alerts,
  count(*) FILTER (severity = 'critical') AS critical,
  round(count(*) FILTER (is_alert) * 100 / count(*), 6) AS alert_rate,
  round(coalesce(avg(anomaly_score) FILTER (is_alert), 0.0), 6) AS mean_score
FROM ticks JOIN weighted ON weighted.bucket <= ticks.bucket GROUP BY ticks.bucket""",
    "severity_weight_actions": _with(LOGS) + f"""SELECT id, severity, weight,
  {_THREAT_LABEL.format('weight')} AS threat_label, {_ACTIONS} AS action FROM weighted""",
    "logs_with_technique": _with(LOGS) + f"SELECT id, {_TECHNIQUE} AS technique FROM logs",
    "technique_coverage": _with(LOGS) + f"""SELECT technique, count(*) AS alerts
FROM (SELECT {_TECHNIQUE} AS technique FROM logs WHERE is_alert) AS t
WHERE technique IS NOT NULL GROUP BY technique""",
    "alert_narratives": _with(LOGS, """shown AS (
  SELECT *, CAST(CAST(round(coalesce(anomaly_score, 0.0), 3) AS DECIMAL(9, 3)) AS VARCHAR) AS score_text,
    regexp_replace(CAST(CAST(duration_seconds AS DECIMAL(18, 2)) AS VARCHAR), '\\.?0+$', '') AS d1
  FROM tiered)""") + """
SELECT id, CASE WHEN is_alert THEN """ + _said(
        NARRATIVE_ALERT,
        "score_text",
        f"""CASE WHEN anomaly_score IS NULL THEN {_literal(NARRATIVE_NO_FEATURES)}
     ELSE 'Flow Duration (+' || d1 || 'σ) and Down/Up Ratio ('
       || CASE WHEN bytes_transferred = 0 THEN '+0' ELSE '-' || bytes_transferred END || 'σ)' END""",
        "coalesce(nullif(event_type, ''), 'anomaly')",
        "coalesce(severity, 'null')",
    ) + " ELSE " + _said(NARRATIVE_NORMAL, "score_text") + """ END AS narrative
FROM shown""",
    "parsed_flows": _with(FLOWS) + f"""SELECT flow_id,
  epoch_us(TIMESTAMP '2024-01-05') AS event_time_us, CAST(NULL AS VARCHAR) AS source_ip,
  label AS event_type, {_TOTAL_BYTES} AS bytes_transferred,
  round(CAST(trunc("Flow Duration") AS BIGINT) / 1000000.0::DOUBLE, 6) AS duration_seconds
FROM labelled""",
    "feature_map": _with(FLOWS) + f"""SELECT flow_id, {_FEATURE_NAMES} AS names,
  {_finite('Flow Bytes/s')} AS bytes_rate, {_finite('Flow Packets/s')} AS packet_rate,
  "Down/Up Ratio" AS ratio FROM flows""",
    "raw_payload_json": _with(FLOWS) + f"""SELECT flow_id, 24 AS keys,
  {_finite('Flow Bytes/s')} AS bytes_rate, {_finite('Flow Packets/s')} AS packet_rate,
  "Flow Duration" AS duration, raw_label AS label FROM flows""",
    "quarantine": _with(MESSAGES) + "SELECT id, value, reasons FROM judged WHERE reasons <> ''",
    "accepted_messages": _with(MESSAGES) + """SELECT id,
  epoch_us(CAST(time_text AS TIMESTAMP)) AS event_time_us, ip AS source_ip, kind AS event_type,
  CAST(bytes AS BIGINT) AS bytes_transferred,
  CAST(json_extract_string(doc, '$.duration_seconds') AS DOUBLE) AS duration_seconds,
  len(json_keys(doc, '$.features')) AS features,
  CAST(json_extract_string(doc, '$.features."Flow Duration"') AS DOUBLE) AS flow_duration
FROM judged WHERE reasons = ''""",
    "ingest_counts": _with(MESSAGES) + """SELECT count(*) FILTER (reasons = '') AS success,
  count(*) FILTER (reasons <> '') AS failed,
  (SELECT string_agg(error, '; ' ORDER BY error) FROM (
     SELECT reasons || ': ' || value AS error FROM judged WHERE reasons <> ''
     ORDER BY error LIMIT 5) AS e) AS first_errors
FROM judged""",
    "label_counts": _with(FLOWS) + "SELECT file, label, count(*) AS rows FROM labelled GROUP BY file, label",
    "label_distribution": _with(FLOWS)
    + "SELECT label, count(*) AS rows FROM labelled GROUP BY label ORDER BY rows DESC",
    "sampling_fractions": _with(FLOWS, "counted AS (SELECT file, label, count(*) AS rows FROM labelled GROUP BY file, label)") + """
SELECT file, label, rows, round(fraction, 9) AS fraction,
  CAST(round_even(fraction * rows, 0) AS BIGINT) AS quota
FROM (SELECT *, CASE WHEN label = 'BENIGN' THEN 0.02::DOUBLE
  ELSE greatest(0.02::DOUBLE, least(1.0::DOUBLE, 300.0::DOUBLE / rows)) END AS fraction FROM counted) AS t""",
    "stratified_sample": _with(FLOWS, SAMPLE) + """SELECT flow_id, file, nullif(label, '') AS label
FROM strata WHERE place <= CAST(round_even(fraction * n, 0) AS BIGINT)""",
    "bernoulli_sample": _with(FLOWS, SAMPLE) + """SELECT flow_id, file, nullif(label, '') AS label
FROM strata WHERE ('0x' || substr(digest, 1, 8))::BIGINT < floor(fraction * 4294967296.0::DOUBLE)""",
    "benign_split": _with(FLOWS) + f"""SELECT flow_id, CASE WHEN NOT is_benign THEN 'attack'
  WHEN ('0x' || substr({DIGEST}, 1, 8))::BIGINT < floor(0.8::DOUBLE * 4294967296.0::DOUBLE) THEN 'train'
  ELSE 'test' END AS part FROM labelled""",
    "replay_order": _with(FLOWS) + f"SELECT flow_id, file FROM flows ORDER BY {DIGEST} LIMIT 5000",
    "flow_csv_source": _with(FLOWS) + """SELECT coalesce(label, '') AS label, count(*) AS rows,
  count(*) FILTER (isfinite("Flow Bytes/s")) AS finite_rates,
  CAST(sum(CASE WHEN isfinite(TRY_CAST("Total Length of Fwd Packets" AS DOUBLE))
    THEN CAST(TRY_CAST("Total Length of Fwd Packets" AS DOUBLE) AS BIGINT) END) AS BIGINT) AS bytes
FROM labelled GROUP BY 1""",
    "feature_params": _with(FLOWS, PARAMS) + """SELECT position, feature, round(median, 6) AS median,
  round(mean, 3) AS mean, round(scale, 3) AS scale FROM params""",
    "clean_benign_rows": _with(FLOWS, PARAMS)
    + """SELECT count(*) AS rows, round(sum("Flow Bytes/s"), 2) AS rates FROM clean""",
    "scaled_features": _with(FLOWS, PARAMS) + "SELECT flow_id, " + ", ".join(
        f"round((coalesce({_finite(c)}, (SELECT median FROM params WHERE position = {i})) "
        f"- (SELECT mean FROM params WHERE position = {i})) "
        f"/ (SELECT scale FROM params WHERE position = {i}), 5) AS z{i}"
        for i, c in enumerate(FEATURE_COLUMNS)
    ) + " FROM labelled",
    "class_feature_summary": _with(
        FLOWS,
        "classed AS (SELECT *, CASE WHEN is_benign THEN 'benign' ELSE 'attack' END AS class FROM labelled)",
    ) + f"SELECT class, feature, round(mean, 3) AS mean, round(std, 3) AS std FROM ({_PER_CLASS}) AS t",
    "deviations_long": _with(FLOWS, PARAMS, LONG) + """SELECT coalesce(label, '') AS label, feature,
  round(avg(abs(z)), 5) AS deviation FROM long GROUP BY 1, 2""",
    "top_deviation_features": _with(FLOWS, PARAMS, LONG) + """
SELECT flow_id, place, feature, round(z, 2) AS deviation FROM (
  SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY abs(z) DESC, position) AS place
  FROM long) AS t WHERE place <= 5""",
    "fixed_detector_logs": _with(
        FLOWS,
        IMPUTED,
        FOREST.replace("FROM labelled", "FROM imputed"),
        """scored AS (SELECT *, "Total Backward Packets" > 2 AS has,
    1.0 / (1.0 + exp(decision * 80.0::DOUBLE)) AS score FROM forest)""",
        RANKED,
    ) + """SELECT scored.flow_id, CASE WHEN has THEN round(score, 9) END AS anomaly_score,
  has AND score >= 0.6 AS is_alert,
  CASE WHEN NOT has OR score < 0.6 THEN NULL WHEN score < 0.75 THEN 'high' ELSE 'critical' END
    AS severity,
  CASE WHEN has THEN names ELSE '' END AS top_features
FROM scored JOIN ranked USING (flow_id)""",
    "fixed_forest_scores": _with(FLOWS, FOREST) + """
SELECT flow_id, round(decision, 9) AS decision,
  round(1.0 / (1.0 + exp(decision * 80.0::DOUBLE)), 9) AS anomaly_score,
  CASE WHEN decision < 0 THEN 1 ELSE 0 END AS is_outlier,
  1.0 / (1.0 + exp(decision * 80.0::DOUBLE)) >= 0.6 AS is_alert FROM forest""",
    "tuned_threshold": _with(
        FLOWS,
        SCORES,
        """cuts AS (SELECT DISTINCT score AS cut FROM scores),
curve AS (SELECT cut, count(*) FILTER (y = 1) AS tp, count(*) FILTER (y = 0) AS fp
  FROM cuts JOIN (SELECT y, score FROM scores) AS s ON s.score >= cut GROUP BY cut),
totals AS (SELECT count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM scores)""",
    ) + """SELECT round(cut, 12) AS threshold, round(tp / p, 9) AS recall, round(fp / n, 9) AS fpr
FROM curve, totals WHERE fp / n <= 0.05 ORDER BY tp DESC, cut DESC LIMIT 1""",
    "roc_points": _with(
        FLOWS,
        SCORES,
        """counted AS (SELECT score, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n
  FROM scores GROUP BY score),
summed AS (SELECT score, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS fp,
    sum(p) OVER () AS all_p, sum(n) OVER () AS all_n
  FROM counted WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))""",
    ) + """SELECT round(score, 12) AS threshold, tp, fp, round(tp / all_p, 9) AS tpr,
  round(fp / all_n, 9) AS fpr FROM summed""",
    "confusion_metrics": _with(
        FLOWS, SCORES, "predicted AS (SELECT y, score >= 0.5 AS flagged FROM scores)", CONFUSION
    ) + """SELECT round(precision, 9) AS precision, round(recall, 9) AS recall,
  round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0), 9) AS f1,
  round(fpr, 9) AS fpr,
  round(coalesce(0.196 * recall / nullif(0.196 * recall + 0.804 * fpr, 0), 0.0), 9)
    AS adjusted_precision, tp, tn, fp, fn FROM rates""",
    "recall_by_label": _with(FLOWS, SCORES) + """SELECT event_type, count(*) AS rows,
  round(avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END), 9) AS recall
FROM scores WHERE y = 1 GROUP BY event_type""",
    "self_flag_rate": _with(FLOWS, FOREST) + """SELECT round(avg(CASE WHEN decision < 0 THEN 1.0 ELSE 0.0 END), 9)
  AS self_flag_rate FROM forest WHERE is_benign""",
    "unscored_logs": _with(FLOWS) + """SELECT flow_id, CAST(NULL AS DOUBLE) AS anomaly_score,
  false AS is_alert, CAST(NULL AS VARCHAR) AS severity, 0 AS top_features FROM flows""",
    "stream_scored_logs": _with(MESSAGES) + """SELECT id,
  epoch_us(CAST(time_text AS TIMESTAMP)) AS event_time_us, ip AS source_ip, kind AS event_type,
  CAST(bytes AS BIGINT) AS bytes_transferred, false AS is_alert,
  CAST(NULL AS DOUBLE) AS anomaly_score FROM judged WHERE reasons = ''""",
    "stream_totals": _with(LOGS) + """SELECT 2 * count(*) AS total_logs,
  2 * count(*) FILTER (is_alert) AS total_alerts, 2 * count(*) FILTER (severity = 'low') AS low,
  2 * count(*) FILTER (severity = 'medium') AS medium, 2 * count(*) FILTER (severity = 'high') AS high,
  2 * count(*) FILTER (severity = 'critical') AS critical FROM tiered""",
    "stream_timeline": _with(LOGS)
    + "SELECT bucket, count(*) AS alerts FROM weighted WHERE is_alert GROUP BY bucket",
    "stream_logs_per_minute": _with(LOGS) + """SELECT bucket + step AS bucket, count(*) AS logs_per_minute
FROM weighted, (SELECT unnest(range(0, 20)) AS step) AS steps GROUP BY 1""",
    "stream_source_state": _with(LOGS) + _SOURCE_STATE,
    "stream_categories": _with(LOGS) + f"""SELECT event_type, alerts, round(mean_score, 9) AS mean_score,
  {_TECHNIQUE} AS technique FROM (
  SELECT coalesce(nullif(event_type, ''), 'Unknown') AS event_type, count(*) AS alerts,
    avg(anomaly_score) AS mean_score FROM logs WHERE is_alert GROUP BY 1) AS t""",
    "stream_live_lists": _with(LOGS) + """SELECT id, epoch_us(created_at) AS created_at_us, is_alert
FROM logs ORDER BY created_at DESC, id DESC LIMIT 60""",
    "live_frames": _with(LOGS) + """SELECT 'log' AS type, id, source_ip, event_type,
  round(anomaly_score, 9) AS anomaly_score, is_alert, severity, 0 AS top_features FROM tiered""",
}
ORACLE["stream_threat_index"] = ORACLE["threat_index"]
