"""Session defaults and the one place that writes intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"

# Java leaves methods of more bytecode than this uncompiled, which makes wide rows many times slower.
# Spark then generates smaller methods, one operator at a time.
METHOD_LIMIT_CONF = ("spark.sql.codegen.hugeMethodLimit", "8000")

# A side is broadcast only after counting that it has no more rows than this.
BROADCAST_ROW_LIMIT = 100_000


def build_session(
    app_name: str = "logvane",
    master: str | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """A session with UTC time, AQE with skew handling and Arrow exchange."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **dict([METHOD_LIMIT_CONF]),
    }
    settings.update(conf or {})
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the session.

    A private temporary folder is used only in local mode with nothing set;
    on a cluster a machine-local folder would be lost with its machine.
    """
    sc = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if sc.getCheckpointDir() is None:
        if named is None:
            if not sc.master.startswith("local"):
                raise RuntimeError(f"set {CHECKPOINT_CONF} to a shared folder")
            named = tempfile.mkdtemp(prefix="logvane-checkpoint-")
        sc.setCheckpointDir(named)
    return named or sc.getCheckpointDir()


def scratch_path(spark: SparkSession) -> str:
    """A new folder below the session's checkpoint folder."""
    return f"{checkpoint_dir(spark)}/logvane/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to shared storage and read it back.

    Later passes read only the columns they use from the written copy, which
    does not depend on any executor staying alive.
    """
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, row_limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Materialize a lookup side and hint a broadcast only if it is small.

    Above the limit the side is returned unhinted: the join then shuffles and
    adaptive execution splits skewed keys.
    """
    side = materialize(df)
    return F.broadcast(side) if side.count() <= row_limit else side


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition an input that has fewer splits than the session has cores.

    Only small inputs (such as one file with a single row group) qualify, so
    the shuffle this adds is bounded by what one task could read. Hashing
    near-unique keys is stable under retries and needs no sort.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df
