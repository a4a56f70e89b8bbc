"""Raw and prepared flow files."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logvane.schema import LABEL_COLUMN


def strip_names(df: DataFrame) -> DataFrame:
    """Column names without surrounding whitespace."""
    return df.toDF(*[c.strip() for c in df.columns])


def label_column(columns: Sequence[str]) -> str:
    """The label column as it is spelled in a header."""
    for name in columns:
        if name.strip() == LABEL_COLUMN:
            return name
    raise ValueError(f"no {LABEL_COLUMN!r} column in the header")


def unique_names(columns: Sequence[str]) -> list[str]:
    """Stripped names; the second of a name gets ``.1``, the third ``.2``, and so on."""
    seen: dict[str, int] = {}
    out = []
    for name in (c.strip() for c in columns):
        seen[name] = seen.get(name, -1) + 1
        out.append(f"{name}.{seen[name]}" if seen[name] else name)
    return out


def read_flow_csv(spark: SparkSession, path: str) -> DataFrame:
    """A folder of flow CSVs as text columns plus the ``file`` of each row.

    Values stay text: files mix numbers with "Infinity" and blanks, and the
    parsing expressions read them strictly. Every file is read by its own
    header, so columns may stand in any order, repeat a name or be missing
    (null then). Files that share a header are read together: as many
    scans as there are different headers, whatever the number of files.
    """
    # The first line of a file is the one whose block starts it.
    start = spark.read.text(path).select(
        "value",
        "_metadata.file_path",
        "_metadata.file_block_start",
        F.monotonically_increasing_id().alias("at"),
    )
    headers = (
        start.where("file_block_start = 0")
        .groupBy("file_path")
        .agg(F.min_by("value", "at").alias("header"))
        .groupBy("header")
        .agg(F.collect_list("file_path").alias("files"))
        .collect()
    )
    if not headers:
        raise ValueError(f"no flow files at {path}")
    frames = []
    for header in sorted(headers, key=lambda r: r["header"]):
        names = unique_names(next(csv.reader([header["header"]])))
        try:
            label_column(names)
        except ValueError as error:
            raise ValueError(f"{error}: {header['files'][0]}") from None
        rows = (
            spark.read.option("header", True)
            .option("ignoreLeadingWhiteSpace", True)
            .option("ignoreTrailingWhiteSpace", True)
            .option("enforceSchema", True)
            .schema(T.StructType([T.StructField(n, T.StringType()) for n in names]))
            .csv(header["files"])
        )
        frames.append(rows.select("*", F.col("_metadata.file_name").alias("file")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_sample(sample: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Store the prepared sample as Parquet (or CSV with a header)."""
    writer = sample.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def read_sample(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Load the prepared sample, naming what to do when it is absent."""
    try:
        reader = spark.read.format(fmt)
        return strip_names((reader.option("header", True) if fmt == "csv" else reader).load(path))
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise FileNotFoundError(
                f"no prepared sample at {path}; draw and write one first"
            ) from error
        raise
