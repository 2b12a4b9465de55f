"""Session settings the operators are designed around (tests and bench use them)."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Skewed joins are split at run time; windows and groupings start from many
# partitions that AQE coalesces, so one setting serves small and large inputs.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Daily rows are few but heavy with window columns: allow small reduce tasks.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "32k",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "tillwise") -> SparkSession:
    """A local session with the library's settings."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared scratch folder.

    Taken from ``spark.checkpoint.dir``. Only a local session (tests) may fall
    back to a machine-local folder; on a cluster the setting is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = os.path.join(tempfile.gettempdir(), "tillwise-shared")
    os.makedirs(folder, exist_ok=True)
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cut lineage before an iterative consumer."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
