"""Session set-up for local runs and tests, and the checkpoint folder.

On a cluster the session comes from the platform; nothing here overrides what
it has already set.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "perilscope", **conf: str) -> SparkSession:
    """A local session with the settings the library is tested under."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(cores if cores != "*" else os.cpu_count() or 8))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
    )
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def partitions_for(spark: SparkSession, rows: int, most: int = 1_000_000) -> int:
    """Partitions to cut to, by number, where rows are about to multiply to ``rows``.

    Adaptive execution sizes partitions by what is in them now, and would put
    rows that are few before they multiply into one task. Every core gets some
    work where there is enough, and no partition more than ``most`` rows.
    """
    cores = spark.sparkContext.defaultParallelism
    return max(1, min(cores, rows // 20_000), -(-rows // most))


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder checkpoints go to: the cluster's own setting where there is one.

    Only a local session without a setting gets a temporary folder; a cluster
    session without one is refused, because its executors share no local disk.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="run-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder and carry on from the files."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
