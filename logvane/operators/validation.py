"""Trust boundary: which client messages may enter the log table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logvane.functions.coerce import finite
from logvane.schema import MAX_LENGTHS, MESSAGE_FIELDS
from logvane.session import materialize

# Message times must be full dates or date-times; Spark alone would take "2024".
_ISO_PREFIX = r"^\s*\d{4}-\d{2}-\d{2}"
_NUMERIC = r"^\s*[+-]?\d+(\.\d+)?\s*$"

# Fixed value: numbers beyond this count milliseconds since 1970, others seconds.
MILLISECONDS_FROM = 2e10

_TEXT_FIELDS = (*MAX_LENGTHS, "raw_payload")


def _typed(field: str) -> Column:
    """A field as its own type; null when absent or of another type.

    Numbers may come as numeric strings or booleans, as lenient JSON readers
    accept them; text fields must be JSON strings.
    """
    given, kind = F.col(f"_given_{field}"), F.col(f"_kind_{field}")
    if field in _TEXT_FIELDS:
        return F.when(kind == "STRING", given.cast("string"))
    number = F.try_variant_get(given, "$", "double")
    if field == "duration_seconds":
        return number
    if field == "bytes_transferred":
        return F.when(
            F.floor(number) == number, F.try_variant_get(given, "$", "bigint")
        )
    if field == "features":
        return F.try_variant_get(given, "$", "map<string,double>")
    text = F.when(kind == "STRING", given.cast("string"))
    instant = F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL)"), number).when(
        text.rlike(_NUMERIC), F.btrim(text).try_cast("double")
    )
    seconds = F.when(F.abs(instant) > MILLISECONDS_FROM, instant / 1000).otherwise(instant)
    return F.when(text.rlike(_ISO_PREFIX), F.btrim(text).try_cast("timestamp")).otherwise(
        F.timestamp_micros(F.round(seconds * 1_000_000).try_cast("bigint"))
    )


def _reasons() -> Column:
    """Every reason to reject a message, in a fixed order."""

    def given(field: str) -> Column:
        return F.col(f"_kind_{field}").isNotNull()

    def wrong_type(field: str) -> Column:
        return F.when(given(field) & F.col(field).isNull(), F.lit(f"type:{field}"))

    bad_features = given("features") & (
        ~F.col("_kind_features").startswith("OBJECT")
        | F.col("features").isNull()
        | F.exists(F.map_values("features"), lambda v: v.isNull())
    )
    unknown = F.transform(
        F.array_sort(F.array_except("_keys", F.array(*[F.lit(f) for f in MESSAGE_FIELDS]))),
        lambda key: F.concat(F.lit("unknown:"), key),
    )
    checks = F.array(
        F.when(~given("event_time"), F.lit("required:event_time")),
        wrong_type("event_time"),
        *[wrong_type(f) for f in _TEXT_FIELDS],
        *[
            F.when(F.length(f) > limit, F.lit(f"too_long:{f}"))
            for f, limit in MAX_LENGTHS.items()
        ],
        wrong_type("bytes_transferred"),
        wrong_type("duration_seconds"),
        F.when(bad_features, F.lit("type:features")),
    )
    is_object = F.col("_message").isNotNull() & F.col("_keys").isNotNull()
    return F.when(~is_object, F.array(F.lit("not_an_object"))).otherwise(
        F.concat(F.array_compact(checks), unknown)
    )


def parse_messages(messages: DataFrame, value: str = "value") -> DataFrame:
    """Parse JSON text once and list every reason to reject it.

    Adds the typed fields and ``reasons`` (empty for a valid message). Client
    messages may not carry unknown keys: ``is_alert`` and ``anomaly_score``
    come from the detector alone. Of a repeated key the last value counts.

    Filter on ``reasons`` only after storing or caching the result: Spark
    would push the filter below the parsing and repeat it there.
    """
    kept = messages.columns
    messages.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    document = messages.withColumns(
        {"_message": F.try_parse_json(value), "_keys": F.json_object_keys(value)}
    )
    fields = document.select(
        *kept,
        "_message",
        "_keys",
        *[
            F.try_variant_get("_message", f"$.{f}", "variant").alias(f"_given_{f}")
            for f in MESSAGE_FIELDS
        ],
    )
    kinds = fields.withColumns(
        {
            f"_kind_{f}": F.nullif(F.schema_of_variant(f"_given_{f}"), F.lit("VOID"))
            for f in MESSAGE_FIELDS
        }
    )
    typed = kinds.withColumns({f: _typed(f) for f in MESSAGE_FIELDS})
    return typed.select(
        *kept,
        *[f for f in MESSAGE_FIELDS if f not in ("duration_seconds", "features")],
        finite(F.col("duration_seconds")).alias("duration_seconds"),
        F.map_filter("features", lambda _, v: finite(v).isNotNull()).alias("features"),
        _reasons().alias("reasons"),
    )


def split_messages(messages: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined): one written parse, then two filters over it."""
    parsed = materialize(parse_messages(messages, value))
    return valid_messages(parsed), quarantined_messages(parsed, messages.columns)


def valid_messages(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.size("reasons") == 0).drop("reasons")


def quarantined_messages(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """Rejected messages as received, with all their reasons."""
    return parsed.where(F.size("reasons") > 0).select(*keep, "reasons")


def replay_summary(
    parsed: DataFrame,
    value: str = "value",
    shown: int = 5,
    arrival: str | None = None,
    seconds: float | None = None,
) -> DataFrame:
    """Accepted and rejected counts with the first few rejections, and messages a second.

    The first rejections are those that came first by the column ``arrival``
    (an offset or number), without one the smallest texts; never a list of all
    is kept. ``seconds`` is how long the replay took, null rate without it.
    """
    kept = [value, *([arrival] if arrival else [])]
    judged = materialize(parsed.select(*kept, "reasons"))
    failed = F.size("reasons") > 0
    counts = judged.agg(
        F.count_if(~failed).alias("success"), F.count_if(failed).alias("failed")
    )
    error = F.concat(F.array_join("reasons", ","), F.lit(": "), F.col(value))
    place = F.col(arrival) if arrival else error
    first = (
        judged.where(failed)
        .select(place.alias("place"), error.alias("error"))
        .orderBy("place", "error")
        .limit(shown)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "error"))), lambda x: x["error"]).alias("e"))
    )
    rate = F.lit(None).cast("double") if seconds is None else (F.col("success") + F.col("failed")) / F.lit(seconds)
    return counts.select(
        "success", "failed", first.scalar().alias("first_errors"), rate.alias("per_second")
    )
