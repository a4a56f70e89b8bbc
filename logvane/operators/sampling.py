"""Class-aware sampling and seeded splits, decided per row by its own hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logvane.functions.coerce import clean_label
from logvane.functions.hashing import digest_below, row_digest
from logvane.schema import BENIGN_LABEL, LABEL_COLUMN
from logvane.session import broadcast_if_small, materialize

# Base share, wanted rows per attack label, seed, training share.
SAMPLE_FRACTION = 0.02
MIN_ATTACK_ROWS = 300
SEED = 42
TRAIN_SHARE = 0.8

# Hash digits added per counting pass, and rows that may be ranked outright.
PREFIX_DIGITS = 3
DIGEST_DIGITS = 32
RANKED_ROWS = 1_000_000


def is_benign(label: str = LABEL_COLUMN) -> Column:
    """By trimmed label; a missing label is no benign row."""
    return F.coalesce(clean_label(F.col(label)) == BENIGN_LABEL, F.lit(False))


def split_benign(df: DataFrame, label: str = LABEL_COLUMN) -> tuple[DataFrame, DataFrame]:
    """(benign, attack)."""
    return df.where(is_benign(label)), df.where(~is_benign(label))


def is_train(ids: Sequence[str], train_share: float = TRAIN_SHARE, seed: int = SEED) -> Column:
    return digest_below(row_digest(seed, ids), train_share)


def train_test_split(
    df: DataFrame, ids: Sequence[str], train_share: float = TRAIN_SHARE, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """Two filters over one hash: no shuffle, and stable under repartitioning."""
    train = is_train(ids, train_share, seed)
    return df.where(train), df.where(~train)


def label_counts(df: DataFrame, by: Sequence[str] = ("file",)) -> DataFrame:
    """Rows per trimmed label within each file; reads only those columns."""
    return (
        df.select(*by, clean_label(F.col(LABEL_COLUMN)).alias("label"))
        .groupBy(*by, "label")
        .agg(F.count("*").alias("rows"))
    )


def label_distribution(df: DataFrame) -> DataFrame:
    """Rows per label, most frequent first."""
    return label_counts(df, by=()).orderBy(F.desc("rows"), "label")


def sampling_fraction(label: Column, rows: Column) -> Column:
    """Base share for benign rows; attacks get at least the wanted rows."""
    floor = F.least(F.lit(1.0), F.lit(float(MIN_ATTACK_ROWS)) / rows)
    return F.when(label == BENIGN_LABEL, F.lit(SAMPLE_FRACTION)).otherwise(
        F.greatest(F.lit(SAMPLE_FRACTION), floor)
    )


def sampling_fractions(df: DataFrame, by: Sequence[str] = ("file",)) -> DataFrame:
    """Fraction and exact quota (half to even) per file and label."""
    return (
        label_counts(df, by)
        .withColumn("fraction", sampling_fraction(F.col("label"), F.col("rows")))
        .withColumn("quota", F.bround(F.col("fraction") * F.col("rows")).cast("bigint"))
    )


def _edge_buckets(buckets: DataFrame, strata: Sequence[str], wanted: str) -> DataFrame:
    """The bucket in which each stratum's running count reaches ``wanted``.

    A stratum has at most ``16 ** PREFIX_DIGITS`` buckets, whatever its size.
    """
    upto = Window.partitionBy(*strata).orderBy("_prefix")
    place = F.col(wanted) - F.col("_upto") + F.col("_rows")
    return (
        buckets.withColumn("_upto", F.sum("_rows").over(upto))
        .where((F.col("_upto") >= F.col(wanted)) & (place > 0))
        .select(*strata, "_prefix", "_rows", place.alias("_place"))
    )


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on equal keys where null equals null; the left side's columns and the rest."""
    named = right.select(
        *[F.col(f"`{k}`").alias(f"_right_{i}") for i, k in enumerate(keys)],
        *[F.col(f"`{c}`") for c in right.columns if c not in keys],
    )
    equal = [F.col(f"`{k}`").eqNullSafe(F.col(f"_right_{i}")) for i, k in enumerate(keys)]
    return left.join(named, equal).drop(*[f"_right_{i}" for i in range(len(keys))])


def _count_prefixes(hashed: DataFrame, strata: Sequence[str], digits: int) -> DataFrame:
    return hashed.groupBy(*strata, F.substring("_digest", 1, digits).alias("_prefix")).agg(
        F.count("*").alias("_rows")
    )


def stratified_sample(
    df: DataFrame,
    ids: Sequence[str],
    by: Sequence[str] = ("file",),
    seed: int = SEED,
    exact: bool = True,
    ranked_rows: int = RANKED_ROWS,
) -> DataFrame:
    """Class-aware sample: the rows with the smallest hashes of each stratum.

    A hot label may hold most rows, so no stratum is ever sorted as a group.
    Narrow counting passes over hash prefixes (4096 buckets each) close in on
    the bucket that holds the quota-th hash until it has few rows; only that
    bucket is ranked, and the sample is then a filter ``hash <= cutoff``.

    With ``exact=False`` each row is kept with its stratum's fraction, which
    needs only the label counts.
    """
    strata = [*by, "_label"]
    label = F.coalesce(clean_label(F.col(LABEL_COLUMN)), F.lit(""))
    hashed = df.withColumn("_label", label).withColumn("_digest", row_digest(seed, ids))
    narrow = hashed.select(*strata, "_digest")
    if exact:
        # Hashed once; the passes read this copy.
        narrow = materialize(narrow)

    if not exact:
        fraction = sampling_fraction(F.col("_label"), F.col("_rows"))
        limit = F.lower(F.hex((fraction * F.lit(2.0**32)).cast("bigint")))
        limits = broadcast_if_small(
            narrow.groupBy(*strata)
            .agg(F.count("*").alias("_rows"))
            .select(*strata, F.lpad(limit, 9, "0").alias("_limit"))
        )
        kept = F.concat(F.lit("0"), F.substring("_digest", 1, 8)) < F.col("_limit")
        return _same(hashed, limits, strata).where(kept).select(*df.columns)

    digits = PREFIX_DIGITS
    total = F.sum("_rows").over(Window.partitionBy(*strata))
    quota = F.bround(sampling_fraction(F.col("_label"), F.col("_total")) * F.col("_total"))
    counted = (
        _count_prefixes(narrow, strata, digits)
        .withColumn("_total", total)
        .withColumn("_quota", quota.cast("bigint"))
    )
    edges = broadcast_if_small(_edge_buckets(counted, strata, "_quota"))
    in_prefix = F.substring("_digest", 1, F.length("_prefix")) == F.col("_prefix")
    while (edges.agg(F.max("_rows")).first()[0] or 0) > ranked_rows:
        if digits >= DIGEST_DIGITS:
            raise ValueError("too many rows share one hash: ids do not tell rows apart")
        digits += PREFIX_DIGITS
        wanted = edges.select(*strata, "_prefix", F.col("_place").alias("_wanted"))
        inside = _same(narrow, wanted, strata).where(in_prefix)
        counted = _count_prefixes(inside.drop("_prefix"), [*strata, "_wanted"], digits)
        edges = broadcast_if_small(
            _edge_buckets(counted, [*strata, "_wanted"], "_wanted").drop("_wanted")
        )
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy("_digest"))
    cutoffs = broadcast_if_small(
        _same(narrow, edges, strata)
        .where(in_prefix)
        .withColumn("_rank", rank)
        .where(F.col("_rank") == F.col("_place"))
        .select(*strata, F.col("_digest").alias("_cutoff"))
    )
    return (
        _same(hashed, cutoffs, strata)
        .where(F.col("_digest") <= F.col("_cutoff"))
        .select(*df.columns)
    )


def replay_order(
    df: DataFrame, ids: Sequence[str], count: int = 0, seed: int = SEED
) -> DataFrame:
    """Seeded shuffle of the rows; the first ``count``, or all for 0."""
    shuffled = df.orderBy(row_digest(seed, ids), *[F.col(f"`{c}`") for c in ids])
    return shuffled.limit(count) if count > 0 else shuffled
