"""Session settings and the shared folder for intermediate results."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Split a hot join key even where that costs a later re-shuffle.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Generated methods above this size are never compiled to machine code by the JVM; Spark
    # then runs the operators of that stage one by one, which is much faster.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # State of streams on the executors' disks instead of their heap; checkpoints get what changed.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

# Can only be set when the session is created.
STARTUP_SETTINGS = {
    # Do not look up the Python call site of every column expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

# Rows of a few numbers in one file of a checkpoint, where their number is about known.
ROWS_A_FILE = 1 << 15


def build_session(name: str = "caseflow", master: str | None = None, **extra) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **STARTUP_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors see, from ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh sub-folder of the shared folder."""
    return os.path.join(shared_dir(spark), f"{purpose}-{uuid.uuid4().hex}")


def cut_lineage(df, rows: int | None = None):
    """Reliable checkpoint, so that lost executors do not replay the whole plan.

    ``rows``, where about known, keeps a small table in few files. On local disks Hadoop starts processes for every
    file to set its permissions, and a process just forked counts as large as its executor.
    """
    shared_dir(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    return df.checkpoint()
