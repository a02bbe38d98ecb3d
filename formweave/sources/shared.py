"""Cutting a plan: rows that are used many times are written to the shared folder once."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.  Only a session in one process (tests) may
    leave it unset: a folder of one machine is lost to all others."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "formweave-checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.  A plan that uses a table in
    ten places holds its lineage ten times; one that uses what was written does not."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: Whether Spark removes the shuffle files of a query as soon as it is done.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """As ``cut``, in a Parquet table: for many wide rows, of which a checkpoint takes several
    times the room, and of which each later step reads a few columns only.  What was shuffled
    for the table is removed with its last row, so steps don't add up on the disks."""
    path = os.path.join(shared_folder(df.sparkSession), f"stored-{uuid.uuid4().hex}")
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before) if before is not None else conf.unset(CLEANUP)
    return df.sparkSession.read.schema(df.schema).parquet(path)
