"""Column expressions that turn dirty source values into typed ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logvane.schema import FEATURE_COLUMNS

_WHITESPACE = " \t\n\r\x0b\x0c"
_INFINITY = float("inf")


def finite(value: Column) -> Column:
    """A double, or null where it is infinite or NaN.

    Spark orders NaN above infinity, so one comparison drops both.
    """
    return F.when(F.abs(value) < F.lit(_INFINITY), value)


def number(value: Column, *, text: bool = False) -> Column:
    """A double, which may be infinite or NaN; null when it is no number.

    With ``text`` the source is a string, where the JVM would also take type
    suffixes and hexadecimal floats ("1d", "0x1p3"); these are no numbers here.
    """
    read = value.try_cast("double")
    return F.when(~value.rlike("[dDfFxXpP]"), read) if text else read


def finite_double(value: Column, *, text: bool = False) -> Column:
    """Read a number, or null when it is no finite number."""
    return finite(number(value, text=text))


def finite_long(value: Column, *, text: bool = False) -> Column:
    """Read a whole number, truncating toward zero; null when not finite."""
    return finite_double(value, text=text).try_cast("bigint")


def rounded(value: Column, digits: int) -> Column:
    """``round`` of a double, without a decimal object for every row.

    A whole number divided by the power of ten is the double nearest to the
    decimal that ``round`` finds. Large numbers and those too near to the middle
    of two decimals are left to ``round``.
    """
    power = F.lit(10.0**digits)
    shifted = value * power
    whole = F.rint(shifted)
    plain = (F.abs(shifted) < F.lit(1e9)) & (F.abs(shifted - whole) < F.lit(0.499999))
    # Adding zero turns a negative zero into zero.
    return F.when(plain, whole / power + F.lit(0.0)).otherwise(F.round(value, digits))


def micros_to_seconds(micros: Column) -> Column:
    return micros / F.lit(1_000_000.0)


def total_bytes(forward: Column, backward: Column) -> Column:
    """Sum of both directions, a missing one counting as zero."""
    return F.try_add(F.coalesce(forward, F.lit(0)), F.coalesce(backward, F.lit(0)))


def clean_label(label: Column) -> Column:
    """Trimmed label; blank becomes null."""
    return F.nullif(F.btrim(label, F.lit(_WHITESPACE)), F.lit(""))


def _is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def read_number(df: DataFrame, name: str) -> Column:
    """A column as doubles, infinities and NaN included."""
    return number(F.col(f"`{name}`"), text=_is_text(df, name))


def column_number(df: DataFrame, name: str, *, whole: bool = False) -> Column:
    """``finite_double``/``finite_long`` of a column, null if it is absent."""
    if name not in df.columns:
        return F.lit(None).cast("bigint" if whole else "double")
    read = finite_long if whole else finite_double
    return read(F.col(f"`{name}`"), text=_is_text(df, name))


def feature_map(df: DataFrame, columns: Sequence[str] = FEATURE_COLUMNS) -> Column:
    """map<feature, value> holding only the finite values present."""
    present = [c for c in columns if c in df.columns]
    if not present:
        return F.create_map().cast("map<string,double>")
    return F.map_filter(
        F.map_from_arrays(
            F.array(*[F.lit(c) for c in present]),
            F.array(*[column_number(df, c) for c in present]),
        ),
        lambda _, value: value.isNotNull(),
    )


def json_payload(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """The whole row as JSON; non-finite numbers become null, nulls are kept."""
    fields = []
    for name in columns or df.columns:
        column = F.col(f"`{name}`")
        if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
            column = finite(column)
        fields.append(column.alias(name))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def iso8601(instant: Column) -> Column:
    """ISO-8601 text with offset; a zero fraction is left out."""
    fraction = F.unix_micros(instant) % F.lit(1_000_000)
    return F.when(
        fraction == 0, F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ssxxx")
    ).otherwise(F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"))
