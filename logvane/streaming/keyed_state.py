"""State per key as a table of versions: a micro-batch writes the keys it saw, nothing else.

Every figure kept is folded: what a batch adds and what is stored combine in any
order (sums, maxima). So a batch is aggregated by itself and written as its own
version, without reading what is stored; a retried batch replaces its version.
Reading folds all versions; ``compact`` folds the older ones into one and drops
keys that have been silent for too long. Nothing is kept in executors' memory.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# The version under which stored logs are folded in before a stream starts.
SEED = -1


@dataclass(frozen=True)
class Folded:
    """A figure: how a batch of rows gives it, and how stored ones combine."""

    name: str
    made: Column
    fold: Callable[[str], Column] = F.sum


def total(name: str, column: Column) -> Folded:
    """A sum or count."""
    return Folded(name, column)


def largest(name: str, column: Column) -> Folded:
    return Folded(name, F.max(column), F.max)


@dataclass
class KeyedState:
    """Figures for each value of ``keys``; without keys there is one row.

    ``clock`` is a figure that holds a key's newest time; with ``idle_seconds``
    a key expires when it lies that far behind the newest of all.
    """

    spark: SparkSession
    path: str
    keys: Sequence[str]
    figures: Sequence[Folded]
    clock: str | None = None
    idle_seconds: int | None = None
    _columns: list[str] = field(init=False)

    def __post_init__(self) -> None:
        if (self.idle_seconds is None) != (self.clock is None):
            raise ValueError("a key's expiry needs both its clock and its idle time")
        self._columns = [*self.keys, *[f.name for f in self.figures]]

    def _stored(self, folder: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/{folder}")
        except AnalysisException as error:
            if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def _versions(self) -> DataFrame | None:
        """All versions; those that the newest compaction holds are left out."""
        folded, versions = self._stored("folded"), self._stored("versions")
        if folded is None or versions is None:
            return versions if folded is None else folded
        upto = folded.agg(F.max("upto")).first()[0]
        base = folded.where(F.col("upto") == upto).select("version", *self._columns)
        return base.unionByName(versions.where(F.col("version") > upto).select("version", *self._columns))

    def add(self, rows: DataFrame, batch: int) -> None:
        """Fold a batch in: one row for each key it has, written as the batch's version."""
        made = rows.groupBy(*self.keys).agg(*[f.made.alias(f.name) for f in self.figures])
        made.write.mode("overwrite").parquet(f"{self.path}/versions/version={batch}")

    def seed(self, rows: DataFrame) -> None:
        """What was stored before the stream's first batch."""
        self.add(rows, SEED)

    def _fold(self, versions: DataFrame) -> DataFrame:
        return versions.groupBy(*self.keys).agg(*[f.fold(f.name).alias(f.name) for f in self.figures])

    def _alive(self, state: DataFrame) -> DataFrame:
        if self.idle_seconds is None:
            return state
        newest = state.agg(F.max(self.clock)).first()[0]
        return state.where(F.col(self.clock) >= F.lit(newest) - F.expr(f"interval {self.idle_seconds} seconds"))

    def read(self) -> DataFrame:
        """The state now: one row for each key that has not expired."""
        versions = self._versions()
        if versions is None:
            raise ValueError(f"nothing has been folded into {self.path}")
        return self._alive(self._fold(versions))

    def changes(self, batch: int) -> DataFrame:
        """The state of the keys that a batch changed, as an update for those who follow it."""
        changed = self.spark.read.parquet(f"{self.path}/versions/version={batch}")
        if not self.keys:
            return self.read()
        return self.read().join(changed.select(*self.keys).distinct(), list(self.keys), "left_semi")

    def compact(self, upto: int) -> None:
        """Fold the versions up to ``upto`` into one. Keys expire here for good; later rows start them anew.

        The fold is complete before anything reads it, and the versions it
        holds are skipped from then on; so a compaction that is cut short changes nothing.
        """
        versions = self._versions()
        if versions is None:
            return
        own = self._alive(self._fold(versions.where(F.col("version") <= upto)))
        stamped = own.withColumn("version", F.lit(upto).cast("int"))
        stamped.write.mode("overwrite").parquet(f"{self.path}/folded/upto={upto}")

    def start(self, rows: DataFrame, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.add)
        if available_now:
            writer = writer.trigger(availableNow=True)
        return writer.start()
