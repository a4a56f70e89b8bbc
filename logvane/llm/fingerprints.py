"""Document fingerprints: every word-shingle hash below a fixed fraction of the hash range.

The share kept is fixed, not the number, so a sketch grows with its text: two
sketches made apart can be merged by a union, and the containment of a short
text in a very long one is estimated from the short one's hashes. Everything
is column expressions over a row's own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logvane.llm.common import id_and_text, words_of
from logvane.session import materialize

SHINGLE = 5
FRACTION = 1 / 8


def _below(fraction: float) -> int:
    """The signed value under which ``fraction`` of all 64-bit hashes lie."""
    if not 0 < fraction <= 1:
        raise ValueError("the fraction must be above 0 and at most 1")
    return min(-(1 << 63) + int(fraction * (1 << 64)), (1 << 63) - 1)


def _next(values: str, other: str, step: int) -> Column:
    return F.transform(values, lambda x, i: F.xxhash64(x, F.get(F.col(other), i + step)))


def with_sketch(rows: DataFrame, text: str, sketch: str, fraction: float = FRACTION) -> DataFrame:
    """Add the sorted kept hashes of a text's five-word shingles as an array of longs.

    A text of fewer words is one shingle; one without words (or null) has an
    empty sketch.
    """
    n = F.size("_h1")
    shingles = F.when(
        n >= SHINGLE, F.slice("_h5", 1, F.greatest(n - (SHINGLE - 1), F.lit(0)))
    ).otherwise(F.slice(F.array(F.xxhash64("_h1")), 1, F.least(n, F.lit(1))))
    limit = F.lit(_below(fraction))
    return (
        rows.withColumn("_h1", F.transform(words_of(F.col(text)), lambda w: F.xxhash64(w)))
        .withColumn("_h2", _next("_h1", "_h1", 1))
        .withColumn("_h4", _next("_h2", "_h2", 2))
        .withColumn("_h5", _next("_h4", "_h1", 4))
        .withColumn(sketch, F.array_sort(F.array_distinct(F.filter(shingles, lambda x: x < limit))))
        .drop("_h1", "_h2", "_h4", "_h5")
    )


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either).otherwise(0.0)


def containment(part: Column, whole: Column) -> Column:
    """Estimated share of the first text's shingles that the second has; 0 for an empty sketch."""
    return F.when(F.size(part) > 0, F.size(F.array_intersect(part, whole)) / F.size(part)).otherwise(0.0)


def merge(a: Column, b: Column) -> Column:
    """The sketch of two texts together."""
    return F.array_sort(F.array_union(a, b))


def as_string(text: Column, sketch: Column) -> Column:
    """A digest of the exact text, then the kept hashes: texts without kept hashes differ too."""
    hashes = F.array_join(F.transform(sketch, lambda x: F.hex(x)), ",")
    return F.concat_ws(":", F.hex(F.xxhash64(F.coalesce(text, F.lit("")))), hashes)


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fraction: float = FRACTION
) -> DataFrame:
    """doc_id, sketch and fingerprint string of every row; a null text counts as empty."""
    rows = with_sketch(id_and_text(docs, id_col, text_col), "text", "sketch", fraction)
    return rows.select("doc_id", "sketch", as_string(F.col("text"), F.col("sketch")).alias("fingerprint"))


def _successors(keys: DataFrame) -> DataFrame:
    """key, next_key and take (code points wanted of the next) in ascending order of ids.

    ``keys`` is narrow: id, key, n_chars. It is range-partitioned and sorted;
    each block's last row is followed by the first row of the next block, found
    in a table of one row for each block. The last row is followed by the first.
    """
    partitions = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("key")]
    placed = materialize(
        keys.repartitionByRange(partitions, *order).withColumn("block", F.spark_partition_id())
    )
    inside = Window.partitionBy("block").orderBy(*order)
    first = placed.groupBy("block").agg(F.min_by("key", F.struct("doc_id", "key")).alias("first"))
    blocks = first.select(
        "block",
        F.coalesce(
            F.lead("first").over(Window.orderBy("block")),  # as many rows as there are blocks
            F.min_by("first", "block").over(Window.partitionBy()),
        ).alias("after"),
    )
    return (
        placed.withColumn("inner", F.lead("key").over(inside))
        .join(blocks, "block")
        .select(
            "key",
            F.coalesce("inner", "after").alias("next_key"),
            F.floor(F.col("n_chars") / 4).cast("int").alias("take"),
        )
    )


def edited_by_next(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fraction: float = FRACTION
) -> DataFrame:
    """Fingerprints of every text and of the text whose last quarter the next document overwrites.

    The next document is the one with the next larger id (the first after the
    last; null ids come first, equal ids by a hash of their texts). Rows equal
    in id and text are one document and get equal results. Texts and sketches
    are shuffled once, by a hash of id and text; what crosses to the row
    before is only the opening that it asks for, and the sketch.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn(
        "text", F.coalesce("text", F.lit(""))
    )
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    keys = rows.select("doc_id", "key", F.length("text").alias("n_chars")).distinct()
    follows = materialize(_successors(keys))
    # The same exchange feeds both joins: both read all its columns, or it would be planned twice.
    placed = with_sketch(rows, "text", "sketch", fraction).repartition("key")
    wanted = follows.select(F.col("key").alias("before"), F.col("next_key").alias("key"), "take")
    openings = (
        placed.join(wanted, "key")
        .groupBy("before")
        .agg(
            F.first(F.substring(F.col("text"), F.lit(1), F.col("take"))).alias("opening"),
            F.first("sketch").alias("next_sketch"),
            F.first(F.xxhash64("text")).alias("next_exact"),
            F.first("doc_id").alias("next_id"),
        )
        .withColumnRenamed("before", "key")
    )
    keep = F.length("text") - F.floor(F.length("text") / 4)
    edited = placed.join(openings, "key").withColumn(
        "edited",
        F.concat(F.substring(F.col("text"), F.lit(1), keep.cast("int")), F.col("opening")),
    )
    edited = with_sketch(edited, "edited", "edited_sketch", fraction)
    exact = F.xxhash64("text")
    return edited.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("text"), F.col("sketch")).alias("fingerprint"),
        as_string(F.col("edited"), F.col("edited_sketch")).alias("edited_fingerprint"),
        F.when(exact == F.xxhash64("edited"), 1.0)
        .otherwise(likeness(F.col("sketch"), F.col("edited_sketch")))
        .alias("near_edited"),
        F.when(exact == F.col("next_exact"), 1.0)
        .otherwise(likeness(F.col("sketch"), F.col("next_sketch")))
        .alias("near_next"),
        "next_id",
    )
