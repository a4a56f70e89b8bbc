"""The stored log table: creation, idempotent loads, reading the newest days."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logvane.schema import LOG_SCHEMA
from logvane.session import broadcast_if_small, materialize

# An id is the load number followed by the row's place within the load: 33 million loads of up to
# 274 billion rows. Each writer counts its loads by itself, so (writer, id) names a log.
PLACE_BITS = 38
PARTITIONS = ["ingest_date", "writer", "load"]
BULK_WRITER = "bulk"
# Logs in a file of a compacted day.
COMPACTED_ROWS = 5_000_000


def _compacted(last: int) -> int:
    """The number under which loads up to ``last`` stand when compacted; below 0, as no load's is."""
    return -1 - last


def _last_of(compacted: int) -> int:
    return -1 - compacted


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def assign_ids(logs: DataFrame, load: int) -> DataFrame:
    """Unique ids that grow with the load number, without a global sort.

    Rows are counted per partition of a written copy; a row's place is its
    partition's offset plus its index there.
    """
    indexed = materialize(
        logs.withColumn("_partition", F.spark_partition_id()).withColumn(
            "_index", F.monotonically_increasing_id()
        )
    )
    earlier = Window.orderBy("_partition").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition.
    offsets = (
        indexed.groupBy("_partition")
        .agg(F.count("*").alias("_rows"))
        .select(
            "_partition", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset")
        )
    )
    index = F.col("_index") - F.shiftleft(F.col("_partition").cast("bigint"), 33)
    place = F.col("_offset") + index
    checked = F.when(place < 2**PLACE_BITS, place).otherwise(
        F.raise_error(F.lit("a load holds too many rows for its ids"))
    )
    return (
        indexed.join(broadcast_if_small(offsets), "_partition")
        .withColumn("id", F.shiftleft(F.lit(load).cast("bigint"), PLACE_BITS) + checked)
        .drop("_partition", "_index", "_offset")
    )


class LogTable:
    """A Parquet table partitioned by ingestion day, writer and load number.

    Writing a writer's load again replaces its own partitions, so a retried
    micro-batch never duplicates logs; other writers' logs are never touched,
    whatever numbers their loads have. Rows are sorted by score inside each file, which
    lets row-group statistics serve tier filters. A day that is over can be
    compacted: one partition for each writer then, whatever number of loads it had.
    """

    def __init__(self, spark: SparkSession, name: str, location: str):
        self.spark = spark
        self.name = name
        self.location = location

    def create_if_absent(self) -> LogTable:
        columns = ", ".join(
            f"{field.name} {field.dataType.simpleString()}" for field in LOG_SCHEMA
        )
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} "
            f"({columns}, ingest_date date, writer string, load bigint) USING parquet "
            # A table option, as insertInto does not take it from the writer;
            # without it an overwrite would replace the whole table.
            "OPTIONS (partitionOverwriteMode 'dynamic') "
            f"PARTITIONED BY ({', '.join(PARTITIONS)}) LOCATION '{self.location}'"
        )
        return self

    def append(self, logs: DataFrame, load: int, writer: str = BULK_WRITER) -> DataFrame:
        """Store scored logs; ids and ``created_at`` are filled in if absent.

        A load written again replaces all its logs, also those that it stored
        on another day. Gives back the stored rows as they were prepared, with
        the times and ids that the table has.
        """
        if load < 0:
            raise ValueError("loads are numbered from 0")
        if any(n < 0 and _last_of(n) >= load for _, _, n in self.partitions(f"writer = {_quoted(writer)}")):
            raise ValueError(f"load {load} of {writer!r} has been compacted and can't be written again")
        if "created_at" not in logs.columns:
            logs = logs.withColumn("created_at", F.current_timestamp())
        if "id" not in logs.columns:
            logs = assign_ids(logs, load)
        stored = logs.select(
            *[
                F.col(f.name).cast(f.dataType) if f.name in logs.columns
                else F.lit(None).cast(f.dataType).alias(f.name)
                for f in LOG_SCHEMA
            ],
            F.to_date("created_at").alias("ingest_date"),
            F.lit(writer).alias("writer"),
            F.lit(load).cast("bigint").alias("load"),
        )
        stored = materialize(stored)
        (
            stored.sortWithinPartitions("ingest_date", "anomaly_score")
            .write.mode("overwrite")
            .insertInto(self.name)
        )
        self._drop_other_days(stored, load, writer)
        return stored

    def partitions(self, spec: str) -> list[tuple[str, str, int]]:
        """(day, writer, load) of the partitions under a specification; names only, no log is read."""
        listed = self.spark.sql(f"SHOW PARTITIONS {self.name}" + (f" PARTITION ({spec})" if spec else ""))
        part = lambda key: F.regexp_extract("partition", rf"{key}=([^/]+)", 1).alias(key)
        rows = listed.select(*[part(key) for key in PARTITIONS]).collect()
        return sorted((r[0], unquote(r[1]), int(r[2])) for r in rows)

    def _drop(self, day: str, writer: str, load: int) -> None:
        spec = f"ingest_date = '{day}', writer = {_quoted(writer)}, load = {load}"
        self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION ({spec})")

    def compact(self, day: str, rows_per_file: int = COMPACTED_ROWS) -> None:
        """Make one partition of each writer's loads of a day that gets no more logs.

        The compacted partition is complete before the loads it holds are
        dropped, and names the last of them: a run that was cut short is
        finished by the next one, and a load that it holds can't be written again.
        """
        writers: dict[str, list[int]] = {}
        for _, writer, load in self.partitions(f"ingest_date = '{day}'"):
            writers.setdefault(writer, []).append(load)
        for writer, loads in writers.items():
            done = max((_last_of(n) for n in loads if n < 0), default=-1)
            waiting = [n for n in loads if n > done]
            if waiting:
                own = self.read().where(
                    (F.col("ingest_date") == F.lit(day).cast("date"))
                    & (F.col("writer") == writer)
                    & ((F.col("load") > done) | (F.col("load") == _compacted(done)))
                )
                copy = materialize(own.withColumn("load", F.lit(_compacted(max(waiting))).cast("bigint")))
                files = -(-copy.count() // rows_per_file)
                spread = copy.repartitionByRange(files, "anomaly_score", "id") if files > 1 else copy.coalesce(1)
                spread.sortWithinPartitions("anomaly_score").write.mode("overwrite").insertInto(self.name)
                done = max(waiting)
            for load in loads:
                if load != _compacted(done):
                    self._drop(day, writer, load)

    def _drop_other_days(self, stored: DataFrame, load: int, writer: str) -> None:
        """Take out what an earlier run of the load stored on days that it no longer has.

        The table forgets those partitions; their files are left to the folder's clean-up.
        """
        # A load has few days.
        now = {str(r["ingest_date"]) for r in stored.select("ingest_date").distinct().collect()}
        for day, _, _ in self.partitions(f"writer = {_quoted(writer)}, load = {load}"):
            if day not in now:
                self._drop(day, writer, load)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def days(self) -> list[str]:
        """Ingestion days that hold logs, newest first: one row for each day."""
        day = F.date_format("ingest_date", "yyyy-MM-dd").alias("day")
        rows = self.read().select(day).distinct().orderBy(F.desc("day")).collect()
        return [row["day"] for row in rows]

    def newest_days(self, rows: int) -> DataFrame:
        """The fewest newest days that together hold at least ``rows`` logs.

        Filter before asking for days, not after: logs that a later filter drops were counted. A newest-first query needs no older day, so the rest of the table is
        pruned by partition.
        """
        logs, found, oldest = self.read(), 0, None
        for oldest in self.days():
            found += logs.where(F.col("ingest_date") == F.lit(oldest).cast("date")).count()
            if found >= rows:
                break
        if oldest is None:
            return logs
        return logs.where(F.col("ingest_date") >= F.lit(oldest).cast("date"))
