"""Session settings and the places where the engine touches shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when its measured size stays under this bound.
BROADCAST_BYTES = 16 << 20


def local_session(cores: int = 8, memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("siltweave")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="siltweave-"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only a session whose executors are threads of this machine may go without; there it is a temporary one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master == "local" or master.startswith("local["):
        return tempfile.mkdtemp(prefix="siltweave-")
    raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder on the storage that all executors share."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder of the session.

    Checkpoints are files; Spark deletes them with the frames that refer to them where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set, as in :func:`local_session`.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(checkpoint_folder(spark))
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast for ``df`` if its measured size allows it, else leave the choice to AQE.

    ``df`` should be cheap to read, e.g. the result of :func:`cut`. Rows are measured as JSON text.
    """
    size = df.agg(F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= most else df


def spread(df: DataFrame) -> DataFrame:
    """A scan with at least a partition for each core, for Python passes over a few small files.

    Only a scan of fewer partitions than cores is shuffled, so what moves is bounded by
    ``spark.sql.files.maxPartitionBytes`` a core; larger tables are left alone.
    """
    plan = getattr(df, "_jdf", None)
    if plan is None:  # a remote session doesn't tell its partitions
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if plan.rdd().getNumPartitions() < cores else df
