"""Session settings and the one durable cut point the library uses."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime settings every operator is designed for. Join sides are broadcast only by
# Spark's own size check; beyond it the join shuffles and AQE splits hot partitions. Before
# a run Spark only knows the size of the files, and rows made from a small file can be some
# hundred times as large, so that check is strict; AQE broadcasts by the sizes it measures.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": "256k",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # ranked lists of any length are cut in every map task before their shuffle
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000000000",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(name: str = "colloquia", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master is not None:
        builder = builder.master(master).config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
    builder = builder.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return tune(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's ``spark.checkpoint.dir``.

    Only a local master may do without: executors of a cluster cannot share a private folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.split("[")[0] == "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage, so that a lost
    executor never loses the cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def few(df: DataFrame, most: int) -> DataFrame:
    """A cut (``durable``) frame, marked for broadcast where it has at most ``most`` rows. Counted, since
    Spark's size check before a run takes rows made from large tables for large, however few they are."""
    return F.broadcast(df) if df.count() <= most else df
