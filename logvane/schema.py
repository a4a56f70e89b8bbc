"""Column contracts shared by batch and streaming."""

from __future__ import annotations

from pyspark.sql import types as T

# The model's input columns, in model order.
FEATURE_COLUMNS = [
    "Flow Duration",
    "Flow Bytes/s",
    "Flow Packets/s",
    "Fwd Packet Length Mean",
    "Fwd Packet Length Std",
    "Bwd Packet Length Mean",
    "Bwd Packet Length Std",
    "Total Fwd Packets",
    "Total Backward Packets",
    "Flow IAT Mean",
    "Flow IAT Std",
    "SYN Flag Count",
    "ACK Flag Count",
    "RST Flag Count",
    "PSH Flag Count",
    "Init_Win_bytes_forward",
    "Init_Win_bytes_backward",
    "Down/Up Ratio",
]

# Raw flow columns read by name.
LABEL_COLUMN = "Label"
DURATION_COLUMN = "Flow Duration"
FORWARD_BYTES_COLUMN = "Total Length of Fwd Packets"
BACKWARD_BYTES_COLUMN = "Total Length of Bwd Packets"
BENIGN_LABEL = "BENIGN"

# Longest accepted text per message field.
MAX_LENGTHS = {
    "source_ip": 45,
    "destination_ip": 45,
    "protocol": 32,
    "event_type": 64,
    "flag": 16,
}

# The keys a client message may carry.
MESSAGE_FIELDS = [
    "event_time",
    "source_ip",
    "destination_ip",
    "protocol",
    "event_type",
    "bytes_transferred",
    "duration_seconds",
    "flag",
    "raw_payload",
    "features",
]

TOP_FEATURE_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("feature", T.StringType()),
            T.StructField("deviation", T.DoubleType()),
        ]
    )
)

# Columns of a stored log.
LOG_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("event_time", T.TimestampType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("destination_ip", T.StringType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("bytes_transferred", T.LongType()),
        T.StructField("duration_seconds", T.DoubleType()),
        T.StructField("flag", T.StringType()),
        T.StructField("raw_payload", T.StringType()),
        T.StructField("anomaly_score", T.DoubleType()),
        T.StructField("is_alert", T.BooleanType()),
        T.StructField("top_features", TOP_FEATURE_TYPE),
    ]
)

# What a reader of the log table gets, besides the derived severity.
RESPONSE_COLUMNS = [
    "id",
    "event_time",
    "created_at",
    "source_ip",
    "destination_ip",
    "protocol",
    "event_type",
    "bytes_transferred",
    "duration_seconds",
    "flag",
    "anomaly_score",
    "is_alert",
]
