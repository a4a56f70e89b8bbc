"""Raw flow rows to log rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logvane.functions.coerce import (
    clean_label,
    column_number,
    feature_map,
    json_payload,
    micros_to_seconds,
    total_bytes,
)
from logvane.schema import (
    BACKWARD_BYTES_COLUMN,
    DURATION_COLUMN,
    FORWARD_BYTES_COLUMN,
    LABEL_COLUMN,
)


def parse_flows(
    flows: DataFrame,
    event_time: Column | None = None,
    keep: Sequence[str] = (),
    payload_columns: Sequence[str] | None = None,
) -> DataFrame:
    """One log row per flow row, in a single projection.

    Flow files carry no addresses, protocol or time: those are null, and the
    event time is ``event_time`` or now. Scores and alerts are not produced
    here; only the detector may set them.
    """
    label = F.col(LABEL_COLUMN) if LABEL_COLUMN in flows.columns else F.lit(None).cast("string")
    no_text = F.lit(None).cast("string")
    return flows.select(
        *keep,
        (F.current_timestamp() if event_time is None else event_time).alias("event_time"),
        no_text.alias("source_ip"),
        no_text.alias("destination_ip"),
        no_text.alias("protocol"),
        clean_label(label).alias("event_type"),
        total_bytes(
            column_number(flows, FORWARD_BYTES_COLUMN, whole=True),
            column_number(flows, BACKWARD_BYTES_COLUMN, whole=True),
        ).alias("bytes_transferred"),
        micros_to_seconds(column_number(flows, DURATION_COLUMN, whole=True)).alias(
            "duration_seconds"
        ),
        no_text.alias("flag"),
        json_payload(flows, payload_columns).alias("raw_payload"),
        feature_map(flows).alias("features"),
    )
