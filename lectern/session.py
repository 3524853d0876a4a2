"""Session helpers: a local session for tests and benches, table loading, the checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int = 8, app: str = "lectern", shuffle_partitions: int | None = None) -> SparkSession:
    """A local[N] session with the settings the library is tuned for."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LECTERN_DRIVER_MEMORY", "6g"))
        .config("spark.driver.host", "127.0.0.1")
    )
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Rows (of some 50 bytes) up to which a table, counted first, is sent to every task.
BROADCAST_ROWS = 200_000


def sent_if_small(frame: DataFrame) -> DataFrame:
    """The frame, to be broadcast if it has at most BROADCAST_ROWS rows, which are counted; beyond that joins shuffle."""
    return F.broadcast(frame) if frame.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else frame


def spread(frame: DataFrame) -> DataFrame:
    """The rows over all cores where their files have fewer parts than the cluster has cores; larger tables stay as they lie."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which a cluster shares; where it is unset on one machine, as in tests, a folder that goes with the process."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="lectern-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    sc = frame.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(frame.sparkSession))
    return frame.checkpoint(eager=True)
