"""Session settings, the shared folder, and tables written between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Settings for large data. Joins are split on skew even where that costs a shuffle more; many small
# shuffle partitions are merged at run time towards the advisory size.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def apply_settings(spark: SparkSession, shuffle_partitions: int | None = None) -> SparkSession:
    """Set SETTINGS; shuffle_partitions is the number to start from, about the shuffled bytes ÷ 128 MB."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    if shuffle_partitions:
        spark.conf.set("spark.sql.shuffle.partitions", shuffle_partitions)
    return spark


def ensure_checkpoints(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; only a local session gets one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="stockflow-checkpoints-")
    context.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared folder and go on from there, with known sizes and short lineage."""
    spark, folder = df.sparkSession, shared_folder(df.sparkSession, "cut")
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints."""
    ensure_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
