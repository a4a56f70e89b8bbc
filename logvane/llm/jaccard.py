"""Documents that share most of their n-grams: a blocked sparse product with size bounds.

The incidence matrix of distinct documents and n-grams is multiplied with its
own transpose, but only where a product can matter. A pair of sets at Jaccard
similarity t shares at least t times the larger set, so it must share one of the
first n - ceil(t n) + 1 n-grams of either in any order fixed for all documents.
Only those columns are grouped. The order puts n-grams that a sample of
documents shows to be frequent last; any order gives exact results, this one
keeps columns short. A pair whose sizes, or whose places in a shared column,
leave too little room for the overlap is discarded before its overlap is counted;
so is one whose shares of hash slices do (no overlap is larger than the sum of
the lesser counts in each slice), which costs a row of small counts for each document
instead of its whole set.

Rows of equal sets are one row of the matrix. Each column first meets only its
least row (a star, not all pairs); columns whose rows are connected by what was
found need nothing more. What is left, rows of a column in different
components, meets in full under the same bounds and a further one: bitmaps of
the two sets, whose differing classes are elements that only one of them has.
They are compared inside the join, so pairs of unlike rows don't leave it. So a
group of any number of copies costs in proportion to its size, and no link
between different sets that would join two components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logvane.llm.common import id_and_text, slices
from logvane.llm.components import connected
from logvane.llm.shingles import shingle_set
from logvane.session import materialize

# Share of documents looked at for frequent n-grams, how often one must be met there, and how many
# are kept at most (half a megabyte). They decide how fast the join is, never its result.
SAMPLE_SHARE = 16
FREQUENT = 3
MOST_FREQUENT = 65_536
# A side of at most so many 8-byte keys (8 MB) may be broadcast.
BROADCAST_KEYS = 1_000_000
# Slices of the hash range whose element counts bound an overlap from above.
SLICES = 512
# Classes of elements in a set's bitmap, a power of two.
BITS = 2048
# N-grams of a document's list that show where two lists first meet.
HEAD = 6
# Pairs of one left row that travel with one copy of its set.
BLOCK = 256


def least_overlap(percent: int, n: int) -> int:
    """How many elements a set of size n shares at least with any set it is linked to."""
    return -(-percent * n // 100)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = id_and_text(docs, id_col, text_col)
    return rows.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))


def _frequent(rows: DataFrame, size: int) -> np.ndarray:
    """Sorted hashes of n-grams that many documents of the sample have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(t, size) for t in batch.column(0).to_pylist()]
            tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens.view(np.int64)), pa.array(counts)], ["token", "n"]
            )

    sample = rows.where("text is not null").where(F.pmod("key", F.lit(SAMPLE_SHARE)) == 0)
    found = (
        sample.select("text")
        .mapInArrow(run, "token long, n long")
        .groupBy("token")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= FREQUENT)
        .orderBy(F.col("n").desc(), "token")
        .limit(MOST_FREQUENT)
        .select("token")
        .collect()
    )
    return np.sort(np.array([r["token"] for r in found], np.int64).view(np.uint64))


def _signed(rows: DataFrame, size: int, percent: int, last: np.ndarray) -> DataFrame:
    """key, doc_id, node (hash of the set), n and the n-grams that must meet a partner's."""
    shared = rows.sparkSession.sparkContext.broadcast(last)

    def first(tokens: np.ndarray) -> np.ndarray:
        n, last = len(tokens), shared.value
        want = n - least_overlap(percent, n) + 1 if n else 0
        if not len(last) or not n:
            return tokens[:want]
        at = np.minimum(np.searchsorted(last, tokens), len(last) - 1)
        is_last = last[at] == tokens
        return np.concatenate([tokens[~is_last][:want], tokens[is_last][:want]])[:want]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(t or "", size) for t in batch.column(2).to_pylist()]
            node = [hash_of(s) for s in sets]
            sizes = np.array([len(s) for s in sets], np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array(node, pa.int64()),
                    pa.array(sizes),
                    _lists([first(s) for s in sets]),
                    pa.array([slice_counts(s) for s in sets], pa.binary()),
                    _lists([bitmap(s) for s in sets]),
                ],
                ["key", "doc_id", "node", "n", "first", "counts", "bits"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"key long, doc_id {kind}, node long, n int, first array<long>, counts binary, bits array<long>"
    )


def slice_counts(tokens: np.ndarray) -> bytes:
    """How many elements of a set fall into each slice of the hash range; 255 and more are 255."""
    counts = np.bincount((tokens >> np.uint64(55)).astype(np.intp), minlength=SLICES)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Which of ``BITS`` classes a set's elements fall into, as 64-bit words."""
    bits = np.zeros(BITS, np.uint8)
    bits[(tokens & np.uint64(BITS - 1)).astype(np.intp)] = 1
    return np.packbits(bits).view(np.uint64)


def _may_be_alike(percent: int) -> Column:
    """Whether two bitmaps allow the similarity: a class that only one set has is an element that only one has.

    Of sizes n and m with d elements in one set only, the similarity is (n + m - d) / (n + m + d).
    """
    apart = F.zip_with("bits", "other_bits", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    differ = F.aggregate(apart, F.lit(0), lambda total, x: total + x)
    return (F.col("n") + F.col("other_n")) * (100 - percent) >= differ * (100 + percent)


def _may_overlap(pairs: DataFrame, counts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose slice counts allow the overlap.

    A count of 255 stands for any number, so a pair that meets there is bounded by the sizes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SLICES)
                for c in (2, 3)
            )
            n, m = (batch.column(c).to_numpy().astype(np.int64) for c in (4, 5))
            low = np.minimum(left, right)
            most = np.where((low == 255).any(axis=1), np.minimum(n, m), low.sum(axis=1, dtype=np.int64))
            keep = pa.array(most * (100 + percent) >= percent * (n + m))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"]
            )

    side = lambda end, c, n: counts.select(
        F.col("node").alias(end), F.col("counts").alias(c), F.col("n").alias(n)
    )
    joined = pairs.join(side("b", "right", "m"), "b").join(side("a", "left", "l"), "a")
    return joined.select("a", "b", "left", "right", "l", "m").mapInArrow(run, "a long, b long")


def hash_of(tokens: np.ndarray) -> int:
    """A 64-bit name of a sorted set."""
    steps = np.uint64(0x9E3779B97F4A7C15) * np.arange(1, len(tokens) + 1, dtype=np.uint64)
    mixed = (tokens ^ (tokens >> np.uint64(29))) * (steps | np.uint64(1))
    total = np.uint64(len(tokens)) + np.bitwise_xor.reduce(mixed) * np.uint64(31) + mixed.sum(dtype=np.uint64)
    return int(np.uint64(total).view(np.int64))


def _small(side: DataFrame) -> DataFrame:
    """A written side of 8-byte keys, broadcast if counting shows that it stays under 8 MB."""
    return F.broadcast(side) if side.count() <= BROADCAST_KEYS else side


def _sets(rows: DataFrame, keys: DataFrame, size: int) -> DataFrame:
    """node and whole set of the documents named by ``keys`` (key, node); a task gives a node once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches):
            rows = []
            for i, node in enumerate(batch.column(0).to_pylist()):
                if node not in seen:
                    seen.add(node)
                    rows.append(i)
            texts = batch.column(1).take(pa.array(rows, pa.int64())).to_pylist()
            nodes = batch.column(0).take(pa.array(rows, pa.int64()))
            sets = _lists([shingle_set(t, size) for t in texts])
            yield pa.RecordBatch.from_arrays([nodes, sets], ["node", "tokens"])

    wanted = rows.join(_small(keys), "key").select("node", "text")
    return wanted.mapInArrow(run, "node long, tokens array<long>")


def _linked(
    pairs: DataFrame, rows: DataFrame, nodes: DataFrame, keys: DataFrame, size: int, percent: int
) -> DataFrame:
    """The pairs (a, b) of nodes whose sets overlap enough, counted in full where bounds allow it.

    The right set joins its pairs; copies of the left set, one for every block
    of pairs, join blocks, so that a row with a great many partners is spread.
    """
    pairs = materialize(_may_overlap(pairs, nodes, percent))
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    found = materialize(keys.join(ends, "node").groupBy("node").agg(F.min("key").alias("key")))
    sets = _sets(rows, found, size).repartition("node")
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    left = (
        sets.join(blocks.withColumnRenamed("a", "node"), "node")
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(F.col("node").alias("a"), "block", F.col("tokens").alias("left"))
    )
    right = (
        pairs.join(blocks, "a")
        .withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))
        .join(sets.withColumnRenamed("node", "b"), "b")
        .select("a", "b", "block", F.col("tokens").alias("right"))
    )
    both = F.size(F.array_intersect("left", "right"))
    either = F.size("left") + F.size("right") - F.col("both")
    return (
        right.join(left, ["a", "block"])
        .withColumn("both", both)
        .where(100 * F.col("both") >= percent * either)
        .select("a", "b")
        .distinct()
    )


def _room(percent: int) -> Column:
    """Whether sizes and places of two rows in a shared column leave room for the overlap."""
    small, large = F.least("n", "other_n"), F.greatest("n", "other_n")
    rest = F.least(F.col("n") - F.col("at"), F.col("other_n") - F.col("other_at"))
    fits = 100 * small >= percent * large
    return fits & (rest * (100 + percent) >= percent * (F.col("n") + F.col("other_n")))


def _components(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """key, doc_id, n and part (a name of the component, null without shingles) of every row."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be in 1..100")
    signed = materialize(_signed(rows, size, percent, _frequent(rows, size)))
    members = signed.select("key", "doc_id", "node", "n")
    filled = members.where("n > 0")
    keys = filled.select("node", "key")
    # Each distinct set once, each of its first n-grams a row: the product's columns.
    named = materialize(keys.groupBy("node").agg(F.min("key").alias("key")))
    nodes = signed.where("n > 0").join(_small(named.select("key")), "key", "left_semi")
    if not members.groupBy("key").count().where("count > 1").limit(1).isEmpty():
        nodes = nodes.dropDuplicates(["node"])
    nodes = nodes.select("node", "n", "first", "counts", "bits")
    columns = nodes.select("node", "n", F.posexplode("first").alias("at", "token"))
    meeting = (
        columns.groupBy("token")
        .agg(F.min("node").alias("low"), F.max("node").alias("high"))
        .where("low <> high")
        .select("token", "low")
    )
    met = materialize(columns.join(meeting, "token"))
    lowest = met.where("node = low").select(
        "token", F.col("n").alias("other_n"), F.col("at").alias("other_at")
    )
    stars = materialize(
        met.where("node <> low")
        .join(lowest, "token")
        .where(_room(percent))
        .select(F.col("low").alias("a"), F.col("node").alias("b"))
        .distinct()
    )
    links = materialize(_linked(stars, rows, nodes, keys, size, percent))
    parts = connected(links)

    # Rows of a column that are still apart; the least row's component is the column's main one.
    part = met.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    part = part.select("token", "node", "n", "at", "low", "part")
    mains = part.where("node = low").select("token", F.col("part").alias("main"))
    apart = part.join(mains, "token")
    split = apart.where("part <> main").select("token").distinct()
    apart = apart.join(split, "token", "left_semi").drop("low")
    heads = nodes.select("node", F.slice("first", 1, HEAD).alias("head"), "bits")
    apart = materialize(apart.join(heads, "node"))
    other = apart.where("part <> main").select(
        "token",
        F.col("node").alias("other"),
        F.col("n").alias("other_n"),
        F.col("at").alias("other_at"),
        F.col("part").alias("other_part"),
        F.col("head").alias("other_head"),
        F.col("bits").alias("other_bits"),
    )
    one_way = (F.col("part") == F.col("main")) | (F.col("node") < F.col("other"))
    # A pair is made in the first column that its rows share, not in every one, as far as the
    # heads of their lists show it; near copies nearly always share one of these.
    shared = F.get(F.array_intersect("head", "other_head"), 0)
    here = shared.isNull() | (shared == F.col("token"))
    # Bitmaps are held against each other where the rows meet, so that few pairs leave the join.
    fits = (F.col("part") != F.col("other_part")) & one_way & _room(percent) & here & _may_be_alike(percent)
    rest = materialize(
        apart.join(other, "token")
        .where(fits)
        .select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
        .distinct()
        .join(stars, ["a", "b"], "left_anti")
    )
    more = _linked(rest, rows, nodes, keys, size, percent)
    parts = connected(links.union(more))

    part = F.when(F.col("n") > 0, F.coalesce("component", "node"))
    return members.join(parts, "node", "left").select("key", "doc_id", "n", part.alias("part"))


def near_duplicates(
    docs: DataFrame,
    size: int = 4,
    percent: int = 85,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Two rows are linked when their sets' Jaccard similarity is at least
    ``percent`` / 100; component_id is the least id of the connected component.
    Null, empty and wordless texts are linked with nothing: their component is
    their own id. A null id is never a component's id unless all its rows lack
    one. Repeated rows are one row of the product and all come back. Extra
    columns are ignored; an empty table gives an empty result.
    """
    labelled = _components(_keyed(docs, id_col, text_col), size, percent)
    names = labelled.where("n > 0").groupBy("part").agg(F.min("doc_id").alias("component_id"))
    return labelled.join(names, "part", "left").select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def representatives(
    docs: DataFrame,
    size: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One document of each component, the one of least id, with all its columns.

    Ties of id are broken by a hash of the text, null ids come last, and rows
    equal in id and text are one document. Documents without shingles stay.
    """
    labelled = materialize(_components(_keyed(docs, id_col, text_col), size, percent))
    filled = labelled.where("n > 0")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    heads = filled.groupBy("part").agg(F.min(order).alias("head"), F.count("*").alias("rows"))
    heads = heads.where("rows > 1").select("part", F.col("head.key").alias("head"))
    others = filled.join(heads, "part").where("key <> head").select("key").distinct()
    named = docs.withColumn("_key", F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")))
    dropped = materialize(others.withColumnRenamed("key", "_key"))
    kept = named.join(_small(dropped), "_key", "left_anti")
    repeated = labelled.groupBy("key").count().where("count > 1").limit(1)
    if not repeated.isEmpty():
        kept = kept.dropDuplicates(["_key"])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
