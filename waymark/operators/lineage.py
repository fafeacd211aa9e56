"""Cutting the lineage of a table."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame


def local_folder() -> str:
    """A temporary folder of a local session, gone with the process."""
    folder = tempfile.mkdtemp(prefix="spark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Write a table to the folder of ``spark.checkpoint.dir`` and go on from there; a local session without one takes a temporary folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or local_folder())
    return df.checkpoint(eager=True)
