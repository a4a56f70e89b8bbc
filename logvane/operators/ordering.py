"""Global and per-key running computations without a single-task window.

Rows are range-partitioned on the whole ordering key, so a key holding a third
of all rows is cut into many blocks; running values are then stitched across
blocks from one small row per block.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logvane.session import broadcast_if_small, materialize

CHUNK_ROWS = 50_000
BLOCK_ROWS = 5_000_000


def running_sums(
    df: DataFrame, order: Sequence[Column], sums: Mapping[str, Column]
) -> DataFrame:
    """Add running sums (this row included) over the total order ``order``.

    ``order`` must be a total order (end it with a unique id). The blocks are
    written once, because a range partitioning computed twice may differ.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(partitions, df.count() // BLOCK_ROWS + 1)
    keyed = df.select(
        "*",
        *[c.alias(f"_order_{i}") for i, c in enumerate(order)],
        *[c.alias(f"_add_{name}") for name, c in sums.items()],
    )
    ordered = [F.col(f"_order_{i}") for i in range(len(order))]
    blocked = materialize(
        keyed.repartitionByRange(blocks, *ordered).withColumn("_block", F.spark_partition_id())
    )
    # One row per block: the only unpartitioned window, over `blocks` rows.
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocked.groupBy("_block").agg(
        *[F.sum(f"_add_{name}").alias(f"_total_{name}") for name in sums]
    )
    offsets = totals.select(
        "_block",
        *[
            F.coalesce(F.sum(f"_total_{name}").over(earlier), F.lit(0)).alias(f"_base_{name}")
            for name in sums
        ],
    )
    inside = Window.partitionBy("_block").orderBy(*ordered).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    summed = blocked.join(broadcast_if_small(offsets), "_block")
    return summed.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[
            (F.col(f"_base_{name}") + F.sum(f"_add_{name}").over(inside)).alias(name)
            for name in sums
        ],
    )


def with_positions(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """Add the 0-based global position in the total order."""
    counted = running_sums(df, order, {name: F.lit(1)})
    return counted.withColumn(name, F.col(name) - 1)


def trailing_mean(
    df: DataFrame,
    value: Column,
    rows: int,
    order: Sequence[Column],
    by: Sequence[str] = (),
    name: str = "trailing_mean",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Mean of ``value`` over each row and the ``rows - 1`` before it.

    With ``by`` each key has its own history. Chunks of equal size carry in
    the few rows that precede them, so no task depends on a key's size.
    """
    if chunk_rows < rows:
        raise ValueError("a chunk must hold at least one full window")
    keys = [F.col(f"`{c}`") for c in by]
    placed = with_positions(df.withColumn("_value", value), [*keys, *order], "_position")
    own = F.floor(F.col("_position") / chunk_rows).cast("bigint")
    carried = F.col("_position") % chunk_rows >= chunk_rows - (rows - 1)
    chunked = placed.withColumn("_own", own).withColumn(
        "_chunk",
        F.explode(
            F.when(carried, F.array(own, own + 1)).otherwise(F.array(own))
        ),
    )
    window = (
        Window.partitionBy(*by, "_chunk").orderBy("_position").rowsBetween(-(rows - 1), 0)
    )
    return (
        chunked.withColumn(name, F.avg("_value").over(window))
        .where(F.col("_chunk") == F.col("_own"))
        .drop("_value", "_position", "_own", "_chunk")
    )
