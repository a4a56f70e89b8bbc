"""What one source does over time: connection rates and how many ports it touches.

Ports are counted exactly inside a window, and by mergeable sketches beyond it:
one-minute sketches are stored once and united for any longer span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW_SECONDS = 300
SKETCH_SECONDS = 60
# Log2 of a sketch's registers; the relative standard error of an estimate is about 1.04 / 2^(this / 2).
SKETCH_BITS = 12


def sketch_error(bits: int = SKETCH_BITS) -> float:
    return 1.04 / 2 ** (bits / 2)


def _named(connections: DataFrame) -> DataFrame:
    return connections.where(F.col("source_ip").isNotNull() & F.col("event_time").isNotNull())


def window_features(connections: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """source_ip, window_start, flows, flows_per_second, ports and destinations of each source and window.

    Ports and destinations are counted exactly. A first grouping by each of
    their values combines before the shuffle, so a busy source's flows don't
    travel. Null ports aren't counted; flows without source or time are left out.
    """
    window = F.window("event_time", f"{seconds} seconds").alias("w")
    counted = (
        _named(connections)
        .groupBy("source_ip", window)
        .agg(
            F.count("*").alias("flows"),
            F.count_distinct("port").alias("ports"),
            F.count_distinct("destination_ip").alias("destinations"),
        )
    )
    return counted.select(
        "source_ip",
        F.col("w.start").alias("window_start"),
        "flows",
        (F.col("flows") / seconds).alias("flows_per_second"),
        "ports",
        "destinations",
    )


def port_sketches(
    connections: DataFrame, seconds: int = SKETCH_SECONDS, bits: int = SKETCH_BITS, watermark: str | None = None
) -> DataFrame:
    """source_ip, start, flows and a sketch of the ports, of each source and minute; for a stream too."""
    named = _named(connections)
    if watermark is not None:
        named = named.withWatermark("event_time", watermark)
    return (
        named.groupBy("source_ip", F.window("event_time", f"{seconds} seconds").alias("w"))
        .agg(F.count("*").alias("flows"), F.hll_sketch_agg("port", bits).alias("sketch"))
        .select("source_ip", F.col("w.start").alias("start"), "flows", "sketch")
    )


def united(sketches: DataFrame, span: Column, *keys: str) -> DataFrame:
    """Flows and the estimated number of ports, of stored sketches united over ``span``."""
    return (
        sketches.groupBy(*keys, span.alias("span"))
        .agg(F.sum("flows").alias("flows"), F.hll_union_agg("sketch").alias("sketch"))
        .select(*keys, "span", "flows", F.hll_sketch_estimate("sketch").alias("ports"))
    )


def scanning_sources(features: DataFrame, least_ports: int, least_share: float = 0.8) -> DataFrame:
    """Windows in which a source touches many ports, nearly each flow another one."""
    return features.where(
        (F.col("ports") >= least_ports) & (F.col("ports") >= least_share * F.col("flows"))
    )
