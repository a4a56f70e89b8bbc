"""Who an address belongs to: the longest of the prefixes that hold it.

Prefixes are dealt into classes of eight lengths (0-7, 8-15, ...), and within a
class grouped by the bits that all its prefixes have, at most 255 prefixes a
group. An address looks into one group of each class by an equi-join, so no
interval is compared with all others and no prefix is copied to many buckets.
The two classes of short prefixes have at most 257 groups, 65,535 prefixes, and
are broadcast; the others are joined by shuffling. Only different addresses are
looked up; their answers are then joined to the logs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logvane.session import broadcast_if_small

CLASS_BITS = 8
_BITS = 32
# Classes up to this many leading bits have so few prefixes that they fit everywhere.
_BOUNDED_BITS = 8
_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def address_number(text: Column) -> Column:
    """A dotted IPv4 address as a number; null for anything else."""
    octets = F.split(text, r"\.")
    number = F.lit(0).cast("bigint")
    for i in range(4):
        number = number * 256 + F.get(octets, i).try_cast("bigint")
    return F.when(text.rlike(rf"^{_OCTET}(\.{_OCTET}){{3}}$"), number)


def prefixes(ranges: DataFrame, prefix_col: str, owner_col: str) -> DataFrame:
    """network, length and owner of "a.b.c.d/n" prefixes.

    Bits behind the length are cleared. Of equal prefixes the least owner
    counts; prefixes that can't be read, and null owners, are left out.
    """
    parts = F.split(F.col(f"`{prefix_col}`"), "/")
    length = F.when(F.get(parts, 1).rlike(r"^\d{1,2}$"), F.get(parts, 1).try_cast("int"))
    read = ranges.select(
        address_number(F.get(parts, 0)).alias("address"),
        F.when(F.size(parts) == 2, length).alias("length"),
        F.col(f"`{owner_col}`").alias("owner"),
    ).where(F.col("address").isNotNull() & F.col("length").between(0, _BITS) & F.col("owner").isNotNull())
    size = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(_BITS) - F.col("length"))
    network = (F.col("address") - F.pmod(F.col("address"), size)).alias("network")
    return read.select(network, "length", "owner").groupBy("network", "length").agg(F.min("owner").alias("owner"))


def _leading(address: str, bits: int) -> Column:
    return F.shiftright(F.col(address), _BITS - bits)


def longest_prefix(addresses: DataFrame, known: DataFrame) -> DataFrame:
    """network, length and owner for each row of ``addresses`` (address, a number), null where nothing holds it."""
    found = addresses
    matches = []
    for bits in range(0, _BITS + 1, CLASS_BITS):
        own = known.where(F.col("length").between(bits, bits + CLASS_BITS - 1))
        group = own.groupBy(_leading("network", bits).alias("_lead")).agg(
            F.collect_list(F.struct("length", "network", "owner")).alias(f"_in{bits}")
        )
        side = F.broadcast(group) if bits <= _BOUNDED_BITS else group
        keyed = found.withColumn("_lead", _leading("address", bits))
        found = keyed.join(side, "_lead", "left").drop("_lead")
        # Structs compare by length first; one prefix of each length can hold an address.
        holding = F.filter(
            f"_in{bits}",
            lambda p: F.col("address") - F.pmod(F.col("address"), F.expr("1L") * F.pow(F.lit(2), F.lit(_BITS) - p["length"]).cast("bigint"))
            == p["network"],
        )
        matches.append(F.array_max(holding))
    best = found.withColumn("_best", F.coalesce(*reversed(matches)))
    return best.select(
        *addresses.columns,
        F.col("_best.network").alias("network"),
        F.col("_best.length").alias("length"),
        F.col("_best.owner").alias("owner"),
    )


def with_owner(logs: DataFrame, known: DataFrame, address_col: str = "source_ip") -> DataFrame:
    """Logs with network, length and owner of the longest prefix that holds their address.

    Every log stays; an address that is null, no IPv4 address, or in no prefix
    has nulls. Repeated rows stay repeated.
    """
    text = F.col(f"`{address_col}`")
    different = logs.select(text.alias("_text")).where(text.isNotNull()).distinct()
    looked_up = longest_prefix(different.withColumn("address", address_number(F.col("_text"))), known)
    # Beyond the bound both sides shuffle, and adaptive execution splits an address that many logs have.
    answers = broadcast_if_small(looked_up.where("length is not null").drop("address"))
    return logs.join(answers, text == F.col("_text"), "left").drop("_text")
