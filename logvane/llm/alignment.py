"""Where two tokenizers' tokens end together, and how often each pair of ids does: external spill counting.

1. Texts are encoded in slices of a few megabytes. Every slice leaves its texts'
   own figures and, for each radix of B's id, a sorted run of records (pair,
   text, times), compressed in blocks by zstd. All of it is one written table.
2. The runs of a radix, split into groups of planned size however common its
   ids are, are merged over a heap that holds one block of each run; equal
   pairs are summed. The groups' sorted counts are merged the same way. Pairs
   sort by B's id first, so an id's maximum is known where its pairs end. What
   is left for each radix is bounded by the vocabularies, not by the texts.
3. Each group of runs is read once more beside its radix's counts, and what its
   records contribute goes back to their slices, one row for each run.

No task holds more than one group of runs or one slice; nothing but the bytes
of each radix reaches the driver.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logvane.llm.common import id_and_text, mix, slices
from logvane.llm.token_pairs import Encoded, encoder
from logvane.session import materialize

RADIXES = 64
SLICE_ROWS = 1000
BLOCK = 16_384
# Bytes of compressed runs that one group may have: never more than the most, never split below the least.
MOST_GROUP, LEAST_GROUP = 32 << 20, 64 << 10

Block = tuple[np.ndarray, np.ndarray]  # pairs in order, how often


def radix_of(pair: np.ndarray, size_a: int) -> np.ndarray:
    """B's ids dealt out by a hash."""
    return mix(pair // np.uint64(size_a)) % np.uint64(RADIXES)


def _packed(*columns: np.ndarray) -> list[bytes]:
    """Columns of equal length as zstd blocks; the first one is in order and kept as differences."""
    import zstandard

    press, out = zstandard.ZstdCompressor(level=1), []
    for at in range(0, len(columns[0]), BLOCK):
        first, *rest = (c[at : at + BLOCK] for c in columns)
        steps = np.diff(first, prepend=first[:1])
        parts = [first[:1].astype("<u4"), steps.astype("<u4"), *rest]
        out.append(press.compress(b"".join(p.tobytes() for p in parts)))
    return out


def _unpacked(block: bytes, kinds: str) -> list[np.ndarray]:
    """A block's columns: pairs, and one array for each of ``kinds``."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(block)
    sizes = [4, *(np.dtype(f"<{k}").itemsize for k in kinds.split())]
    n = (len(raw) - 4) // sum(sizes)
    steps = np.frombuffer(raw, "<u4", n, 4).astype(np.int64)
    out, at = [int.from_bytes(raw[:4], "little") + np.cumsum(steps)], 4 + 4 * n
    for kind, size in zip(kinds.split(), sizes[1:]):
        out.append(np.frombuffer(raw, f"<{kind}", n, at).astype(np.int64))
        at += size * n
    return out


def runs_of(encoded: Encoded, size_a: int) -> list[tuple[int, list[bytes]]]:
    """A slice's sorted runs (pair, text, times), one for each radix that has any."""
    pair = encoded.code.astype(np.uint64)
    # Radix, pair and text in one number: 6, 32 and 16 bits.
    key = radix_of(pair, size_a) << np.uint64(48) | pair << np.uint64(16) | encoded.row.astype(np.uint64)
    key, times = np.unique(key, return_counts=True)
    radix = (key >> np.uint64(48)).astype(np.int64)
    pair = (key >> np.uint64(16) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = (key & np.uint64(0xFFFF)).astype("<u2")
    stops = np.searchsorted(radix, np.arange(RADIXES + 1))
    return [
        (r, _packed(pair[lo:hi], text[lo:hi], times[lo:hi].astype("<u4")))
        for r, (lo, hi) in enumerate(zip(stops, stops[1:]))
        if hi > lo
    ]


def _summed(pair: np.ndarray, n: np.ndarray) -> Block:
    """Sums of equal neighbours."""
    starts = np.flatnonzero(np.diff(pair, prepend=pair[:1] - 1))
    return pair[starts], np.add.reduceat(n, starts) if len(starts) else n


def counts_in(run: list[bytes], kinds: str = "u2 u4") -> Iterator[Block]:
    """A run's pairs and how often each occurs, block by block; the last of ``kinds`` counts."""
    for block in run:
        columns = _unpacked(block, kinds)
        yield _summed(columns[0], columns[-1])


def merged(runs: Iterable[Iterator[Block]]) -> Iterator[Block]:
    """K-way merge: pairs in order with their sums. Holds one block of each run.

    Two heaps order the blocks in hand by first and by last pair. Whatever lies
    up to the least last pair can be summed, as no later block holds such a pair
    except as its first one; so the least last pair itself waits for its run's next block.
    """
    runs = list(runs)
    hand: dict[int, Block] = {}
    first: list[tuple[int, int]] = []
    last: list[tuple[int, int]] = []

    def take(i: int, pair: np.ndarray, n: np.ndarray) -> None:
        hand[i] = pair, n
        heapq.heappush(first, (int(pair[0]), i))

    def more(i: int) -> None:
        block = next(runs[i], None)
        if block is not None:
            take(i, *block)
            heapq.heappush(last, (int(block[0][-1]), i))

    for i in range(len(runs)):
        more(i)
    carried: Block | None = None
    while last:
        upto, i = heapq.heappop(last)
        parts = [] if carried is None else [carried]
        rest = []
        while first and first[0][0] <= upto:
            _, j = heapq.heappop(first)
            pair, n = hand.pop(j)
            stop = int(np.searchsorted(pair, upto, side="right"))
            parts.append((pair[:stop], n[:stop]))
            if stop < len(pair):
                rest.append((j, pair[stop:], n[stop:]))
        for j, pair, n in rest:
            take(j, pair, n)
        more(i)
        if parts:
            pair, n = (np.concatenate(c) for c in zip(*parts))
            order = np.argsort(pair, kind="stable")
            pair, n = _summed(pair[order], n[order])
            yield pair[:-1], n[:-1]
            carried = pair[-1:], n[-1:]
    if carried is not None:
        yield carried


def _encoded(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    """A row for each slice: its texts' ids and figures, and its runs."""
    rows = id_and_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path_a, path_b)
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 33
        for batch in slices(batches, SLICE_ROWS):
            found = code.encode(batch.column(1).to_pylist())
            listed = [found.n_a, found.n_b, found.n_groups]
            radixes, runs = zip(*r) if (r := runs_of(found, code.size_a)) else ((), ())
            columns = [
                pa.array([number]),
                pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0)),
                *(pa.array([x.tolist()], pa.list_(pa.int64())) for x in listed),
                pa.array([found.digests], pa.list_(pa.string())),
                pa.array([list(radixes)], pa.list_(pa.int32())),
                pa.array([list(runs)], pa.list_(pa.list_(pa.binary()))),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)
            number += 1

    names = ["slice", "doc_id", "n_a", "n_b", "n_groups", "digest", "radixes", "runs"]
    key = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run,
        f"slice long, doc_id array<{key}>, n_a array<long>, n_b array<long>, n_groups array<long>, "
        "digest array<string>, radixes array<int>, runs array<array<binary>>",
    )


def _groups(encoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs with their radix and group, and how many groups each radix has.

    A group has at most the mean of the radixes' bytes, within fixed limits, so
    a radix whose ids are in a third of all links is many groups.
    """
    runs = encoded.select("slice", F.explode(F.arrays_zip("radixes", "runs")).alias("r")).select(
        "slice", F.col("r.radixes").alias("radix"), F.col("r.runs").alias("run")
    )
    size = F.aggregate("run", F.lit(0).cast("long"), lambda total, b: total + F.octet_length(b))
    sizes = runs.groupBy("radix").agg(F.sum(size).alias("bytes"))
    share = F.sum("bytes").over(_everything()) / RADIXES
    target = F.least(F.lit(MOST_GROUP), F.greatest(F.lit(LEAST_GROUP), share))
    planned = materialize(
        sizes.select("radix", F.greatest(F.lit(1), F.ceil(F.col("bytes") / target)).cast("int").alias("groups"))
    )
    # One row for each radix at most.
    grouped = runs.join(F.broadcast(planned), "radix").withColumn(
        "part", F.pmod(F.xxhash64("slice"), F.col("groups")).cast("int")
    )
    return grouped.select("radix", "part", "slice", "run"), planned


def _everything():
    """A window over the radixes' few rows."""
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))


_COUNTED = "radix int, pairs array<binary>"


def _counts(grouped: DataFrame, size_a: int) -> DataFrame:
    """radix and its pairs' counts (pair, count, whether the most for its B id) as blocks, one row each."""

    def row(radix: int, blocks: list[bytes]) -> pa.Table:
        return pa.table(
            [pa.array([radix], pa.int32()), pa.array([blocks], pa.list_(pa.binary()))],
            names=["radix", "pairs"],
        )

    def partly(table: pa.Table) -> pa.Table:
        blocks = []
        for pair, n in merged(counts_in(run) for run in table.column("run").to_pylist()):
            blocks += _packed(pair, n.astype("<i8"))
        return row(table.column("radix")[0].as_py(), blocks)

    def wholly(table: pa.Table) -> pa.Table:
        runs = (counts_in(run, "i8") for run in table.column("pairs").to_pylist())
        pair, n = (np.concatenate(c) for c in zip(*merged(runs)))
        # Pairs of a B id stand together.
        starts = np.flatnonzero(np.diff(pair // size_a, prepend=-1))
        most = np.repeat(np.maximum.reduceat(n, starts), np.diff(starts, append=len(n)))
        return row(table.column("radix")[0].as_py(), _packed(pair, n.astype("<i8"), (n == most).astype("<u1")))

    partial = grouped.select("radix", "part", "run").groupBy("radix", "part").applyInArrow(partly, _COUNTED)
    return partial.groupBy("radix").applyInArrow(wholly, _COUNTED)


def _contributions(grouped: DataFrame, counts: DataFrame, planned: DataFrame) -> DataFrame:
    """slice and, of each run, its texts with the sum of their links' counts and the number of best ones."""

    def run(runs: pa.Table, counted: pa.Table) -> pa.Table:
        known = [_unpacked(b, "i8 u1") for b in counted.column("pairs")[0].as_py()]
        pairs, n, best = (np.concatenate(c) for c in zip(*known))
        slices_, out = [], []
        for number, blocks in zip(runs.column("slice").to_pylist(), runs.column("run").to_pylist()):
            pair, text, times = (np.concatenate(c) for c in zip(*(_unpacked(b, "u2 u4") for b in blocks)))
            at = np.searchsorted(pairs, pair)
            total = np.zeros((2, int(text.max()) + 1), np.int64)
            np.add.at(total[0], text, times * n[at])
            np.add.at(total[1], text, times * best[at])
            slices_.append(number)
            out.append(total.tobytes())
        return pa.table([pa.array(slices_, pa.int64()), pa.array(out, pa.binary())], names=["slice", "sums"])

    spread = counts.join(F.broadcast(planned), "radix").select(
        "radix", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), "pairs"
    )
    keys = ["radix", "part"]
    return grouped.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInArrow(run, "slice long, sums binary")


def align(
    docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    A link is a pair of token occurrences that end at one byte; as no token is
    empty, each group has one. Null and empty texts, and those that a tokenizer
    doesn't give back byte by byte, have no tokens: zeros and an empty digest.
    Repeated rows count each by itself; an empty table gives an empty result;
    other columns are ignored; texts of any length are encoded whole.
    """
    encoded = materialize(_encoded(docs, path_a, path_b, id_col, text_col))
    grouped, planned = _groups(encoded)
    counts = materialize(_counts(grouped, encoder(path_a, path_b).size_a))
    back = _contributions(grouped, counts, planned)
    kind = encoded.schema["doc_id"].dataType.elementType.simpleString()
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def run(own: pa.Table, sums: pa.Table) -> pa.Table:
        ids = own.column("doc_id").combine_chunks().flatten()
        total = np.zeros((2, len(ids)), np.int64)
        for raw in sums.column("sums").to_pylist():
            part = np.frombuffer(raw, np.int64).reshape(2, -1)
            total[:, : part.shape[1]] += part
        n_a, n_b, n_groups, digest = (
            own.column(c).combine_chunks().flatten() for c in ("n_a", "n_b", "n_groups", "digest")
        )
        return pa.table(
            [ids, n_a, n_b, n_groups, n_groups, pa.array(total[1]), pa.array(total[0]), digest],
            names=names,
        )

    figures = encoded.drop("radixes", "runs")
    return (
        figures.groupBy("slice")
        .cogroup(back.groupBy("slice"))
        .applyInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in names[1:-1]) + ", groups_sha256 string")
    )


def pair_counts(
    docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """b, a, n and whether n is the most for b, of every pair of ids that is linked anywhere."""
    encoded = materialize(_encoded(docs, path_a, path_b, id_col, text_col))
    size_a = encoder(path_a, path_b).size_a

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blocks in batch.column(0).to_pylist():
                for block in blocks:
                    pair, n, best = _unpacked(block, "i8 u1")
                    columns = [pair // size_a, pair % size_a, n, best.astype(bool)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["b", "a", "n", "is_best"])

    counts = _counts(_groups(encoded)[0], size_a)
    return counts.select("pairs").mapInArrow(run, "b long, a long, n long, is_best boolean")
