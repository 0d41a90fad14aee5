"""Shared storage for intermediate results that must survive the loss of an executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset, and Spark runs on one machine, a new temporary one.

    On a cluster a folder of the driver's would hold other rows on each machine, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        path = tempfile.mkdtemp(prefix="spark-shared-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        folder = f"file://{path}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are written to the shared folder once and read from there afterwards."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else has.

    The tables of an application lie in one folder, spark-<application id>, which goes with a temporary folder at exit; in
    a folder that was set, it is left to whoever set it, as a result may still be read from there.
    """
    return f"{shared_folder(spark).rstrip('/')}/spark-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Like materialise, but as Parquet (see new_path), so that later readers can skip columns they don't need."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Most rows of a table that is sent to every executor.
BROADCAST_ROWS = 50_000


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows, written down once and counted; marked for broadcast only if there are few enough of them.

    For tables of a few narrow columns. A larger one is joined as Spark sees fit.
    """
    held = materialise(df)
    return F.broadcast(held) if held.count() <= rows else held
