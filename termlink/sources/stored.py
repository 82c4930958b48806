"""Intermediate frames on the storage that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables: the one that ``spark.checkpoint.dir`` names.

    Without one a local session gets its own; on a cluster that is an error, since other machines could not
    read it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="termlink-checkpoint-"))
    return folder or context._jsc.sc().getCheckpointDir().get()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else writes to."""
    return f"{shared_folder(spark)}/termlink/{uuid.uuid4().hex}/{name}"


def stored(frame: DataFrame) -> DataFrame:
    """The same rows behind a reliable checkpoint: later plans begin at the files, whatever it took to make them."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()
