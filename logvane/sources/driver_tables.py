"""Log, flow and message views over the generic test tables.

``events`` carries the log table and ``lineitem`` the flow table. Dirty values
are injected by explicit conditions on the data itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logvane.session import spread

FLOW_IDS = ["flow_id"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _choose(cases: list[tuple[Column, object]], otherwise) -> Column:
    column = F.lit(otherwise) if not isinstance(otherwise, Column) else otherwise
    for condition, value in reversed(cases):
        value = value if isinstance(value, Column) else F.lit(value)
        column = F.when(condition, value).otherwise(column)
    return column


def log_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_entries_of(read_table(spark, sf_dir, "events"))


def log_entries_of(events: DataFrame) -> DataFrame:
    """``events`` as stored logs with a score from the event value."""
    kind, value, user = F.col("event_type"), F.col("value"), F.col("user_id")
    instant = F.col("ts").cast("timestamp")
    return events.select(
        F.col("event_id").alias("id"),
        instant.alias("event_time"),
        instant.alias("created_at"),
        F.concat_ws(
            ".",
            F.lit("10"),
            F.expr("user_id div 65536 % 256").cast("string"),
            F.expr("user_id div 256 % 256").cast("string"),
            (user % 256).cast("string"),
        ).alias("source_ip"),
        F.concat(F.lit("192.168.0."), (user % 256).cast("string")).alias("destination_ip"),
        F.when(user % 2 == 0, F.lit("tcp")).alias("protocol"),
        _choose(
            [
                (kind == "click", "PortScan"),
                (kind == "purchase", "DoS Hulk"),
                (kind == "error", "SSH-Patator"),
                (kind == "view", ""),
            ],
            kind,
        ).alias("event_type"),
        F.get_json_object("props", "$.k").cast("bigint").alias("bytes_transferred"),
        value.alias("duration_seconds"),
        F.lit(None).cast("string").alias("flag"),
        F.col("props").alias("raw_payload"),
        F.when(kind != "signup", value / (value + F.lit(100.0))).alias("anomaly_score"),
        F.when(kind == "signup", value >= F.lit(40.0))
        .otherwise(value / (value + F.lit(100.0)) >= F.lit(0.1))
        .alias("is_alert"),
    )


def flows(spark: SparkSession, sf_dir: str, spread_out: bool = False) -> DataFrame:
    """``lineitem`` as labelled network flows with the 18 model columns.

    ``spread_out`` shares a scan of few splits among all cores, for queries
    that do much work per row.
    """
    lineitem = read_table(spark, sf_dir, "lineitem")
    if spread_out:
        lineitem = spread(lineitem, "l_orderkey", "l_partkey")
    quantity, price = F.col("l_quantity"), F.col("l_extendedprice")
    discount, tax = F.col("l_discount"), F.col("l_tax")
    line = F.col("l_linenumber").cast("bigint")
    order, part, supplier = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    attack = F.col("l_returnflag") == "R"
    flood = attack & (F.col("l_linestatus") == "O")
    burst = F.when(flood & (discount >= 0.05), F.lit(6.0)).otherwise(F.lit(1.0))

    def number(column: Column) -> Column:
        return column.cast("double")

    features = {
        "Flow Duration": price * F.lit(1000.0),
        "Flow Bytes/s": _choose([(discount == 0.0, float("inf"))], price * burst / quantity),
        "Flow Packets/s": _choose(
            [((tax == 0.0) & (discount == 0.05), float("nan"))],
            quantity * (F.lit(1.0) - discount),
        ),
        "Fwd Packet Length Mean": price * discount * burst / quantity,
        "Fwd Packet Length Std": price * tax * burst / quantity,
        "Bwd Packet Length Mean": number(part % 1500),
        "Bwd Packet Length Std": number(supplier % 97) * tax,
        "Total Fwd Packets": quantity * burst,
        "Total Backward Packets": number(line),
        "Flow IAT Mean": price / (quantity + number(line)),
        "Flow IAT Std": price * tax,
        "SYN Flag Count": _choose([(F.col("l_linestatus") == "O", 1.0)], 0.0),
        "ACK Flag Count": _choose([(F.col("l_returnflag") == "N", 1.0)], 0.0),
        "RST Flag Count": number(line % 2),
        "PSH Flag Count": number(part % 2),
        "Init_Win_bytes_forward": number(order % 65536),
        "Init_Win_bytes_backward": number((order * 7 + part) % 8192),
        "Down/Up Ratio": number(line) / quantity,
    }
    label = _choose(
        [
            (flood, "DoS Hulk"),
            (attack, " PortScan"),
            ((line == 7) & (tax == 0.0), "  "),
            (line == 1, " BENIGN "),
        ],
        "BENIGN",
    )
    return lineitem.select(
        F.concat_ws(
            "-",
            order.cast("string"),
            line.cast("string"),
            part.cast("string"),
            supplier.cast("string"),
            F.date_format("l_shipdate", "yyyyMMdd"),
        ).alias("flow_id"),
        F.concat(F.lit("flows_"), F.date_format("l_shipdate", "yyyy"), F.lit(".csv")).alias("file"),
        (part % 1024).alias("Destination Port"),
        _choose([(line == 3, "n/a"), (line == 5, "inf")], part.cast("string")).alias(
            "Total Length of Fwd Packets"
        ),
        _choose([(tax == 0.08, F.lit(None).cast("string"))], supplier.cast("string")).alias(
            "Total Length of Bwd Packets"
        ),
        *[column.alias(name) for name, column in features.items()],
        label.alias("Label"),
    )


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as connections of one day: suppliers are sources, parts are ports."""
    return connections_of(read_table(spark, sf_dir, "lineitem"))


def connections_of(lineitem: DataFrame) -> DataFrame:
    supplier, part = F.col("l_suppkey"), F.col("l_partkey")
    second = F.col("l_orderkey") * 31 + F.col("l_linenumber").cast("bigint") * 7
    day = F.lit(1_704_067_200)  # the first second of 2024
    return lineitem.select(
        F.concat_ws(
            ".", F.lit("10.9"), F.expr("l_suppkey div 256 % 256").cast("string"), (supplier % 256).cast("string")
        ).alias("source_ip"),
        F.concat(F.lit("192.168.0."), (part * 7 % 200).cast("string")).alias("destination_ip"),
        (part % 1024).alias("port"),
        F.timestamp_seconds(day + second % 86_400).alias("event_time"),
    )


def owned_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` as owners of nested address ranges around the logs' addresses, some of them equal."""
    key = F.col("c_custkey")
    length = F.when(key % 97 == 0, key % 20).otherwise(F.lit(20) + key * 7 % 13)
    base = F.concat_ws(
        ".", F.lit("10.0"), F.expr("c_custkey * 37 % 512 div 256").cast("string"), (key * 37 % 256).cast("string")
    )
    return read_table(spark, sf_dir, "customer").select(
        F.concat(base, F.lit("/"), length.cast("string")).alias("prefix"), F.col("c_name").alias("owner")
    )


def verdict_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as analysts' verdicts on logs; many logs have several."""
    status = F.col("o_orderstatus")
    return read_table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") % 9000).alias("id"),
        _choose([(status == "F", "false_positive"), (status == "O", "confirmed")], "unclear").alias("verdict"),
        F.col("o_custkey").alias("analyst"),
        F.col("o_orderdate").cast("timestamp").alias("decided_at"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages_of(spread(read_table(spark, sf_dir, "events"), "event_id"))


def messages_of(events: DataFrame) -> DataFrame:
    """``events`` as client JSON messages, some of which break a rule."""
    number = F.get_json_object("props", "$.k").cast("bigint")
    user = F.col("user_id")
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")

    def quoted(column: Column) -> Column:
        return F.concat(F.lit('"'), column, F.lit('"'))

    def field(name: str, column: Column) -> Column:
        return F.concat(F.lit(f'"{name}": '), column)

    address = F.concat(F.lit("10.0.0."), (user % 256).cast("string"))
    parts = F.concat_ws(
        ", ",
        _choose(
            [(number == 1, F.lit(None).cast("string")), (number == 2, field("event_time", F.lit("null"))),
             (number == 3, field("event_time", F.lit('"yesterday"')))],
            field("event_time", quoted(time)),
        ),
        _choose(
            [(number == 4, field("source_ip", quoted(F.repeat(F.lit("9"), 46)))),
             (number == 5, field("source_ip", F.lit("12")))],
            field("source_ip", quoted(address)),
        ),
        field("event_type", quoted(F.col("event_type"))),
        _choose(
            [(number == 6, field("bytes_transferred", F.lit("1.5"))),
             (number == 7, field("bytes_transferred", F.lit('"many"'))),
             (number == 8, field("bytes_transferred", F.lit("null")))],
            field("bytes_transferred", number.cast("string")),
        ),
        field("duration_seconds", number.cast("string")),
        _choose(
            [(number == 9, field("features", F.lit('{"Flow Duration": "slow"}'))),
             (number == 10, field("features", F.lit("[1, 2]"))),
             (number == 11, field("features", F.lit("{}")))],
            field(
                "features",
                F.concat(F.lit('{"Flow Duration": '), number.cast("string"),
                         F.lit(', "Total Fwd Packets": 3, "other": 1.25}')),
            ),
        ),
        F.when(number == 12, F.lit('"is_alert": true')),
        F.when(number.isin(12, 13), F.lit('"anomaly_score": 0.1')),
    )
    value = _choose(
        [(number == 14, F.concat(F.lit("{"), parts)), (number == 15, F.lit("[1, 2]"))],
        F.concat(F.lit("{"), parts, F.lit("}")),
    )
    return events.select(F.col("event_id").alias("id"), value.alias("value"))
