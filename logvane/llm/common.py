"""What the text operators share: input columns, Arrow batches, byte-string hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are runs of anything but these six characters: space, tab, \n, \v, \f, \r.
SPACES = r"[\x20\x09-\x0D]+"

_BASE = 0x9E3779B97F4A7C15
_ONE = np.uint64(1)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, under fixed names, so no other column can clash."""
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")
    )


def words_of(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def is_held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for the rows a learner never sees: crc32 of the id's text divisible by ``folds``."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that their order is as good as random."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of the hash base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            self.up = _geometric(_BASE, size)
            self.down = _geometric(pow(_BASE, -1, 1 << 64), size)


def _geometric(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


POWERS = Powers()


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Polynomial sums over all prefixes of a byte array; see ``span_hash``."""
    POWERS.reach(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _ONE) * POWERS.up[: len(data)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, stop): equal bytes give equal hashes wherever they stand."""
    return mix((sums[stop] - sums[start]) * POWERS.down[start] + (stop - start).astype(np.uint64))


# Functions that keep something large in a Python worker, which Spark uses again for other operators.
_KEEPERS: list = []


def keeper(function):
    """Mark a cached function whose cache ``keep_only`` may drop."""
    _KEEPERS.append(function)
    return function


def keep_only(*used) -> None:
    """Drop what other operators have left in this worker."""
    for function in _KEEPERS:
        if function not in used and function.cache_info().currsize:
            function.cache_clear()


def texts_of(batches: Iterator) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts (null: empty) of each Arrow batch."""
    for batch in batches:
        yield batch.column(0), [t or "" for t in batch.column(1).to_pylist()]


def slices(batches: Iterator, most_rows: int = 1000, most_bytes: int = 6 << 20) -> Iterator:
    """Arrow batches cut into pieces of a few megabytes, so that a task's arrays stay small.

    A single row of more bytes is a piece of its own.
    """
    for batch in batches:
        rows = min(most_rows, batch.num_rows)
        row_bytes = batch.nbytes / max(1, batch.num_rows)
        step = max(1, min(rows, int(most_bytes / max(1.0, row_bytes))))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
