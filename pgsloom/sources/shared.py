"""Folders that the driver and all executors share, and tables cut from their lineage by way of them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder of this machine only where Spark runs on this machine alone."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return re.sub(r"^file:/+", "file:///", context.getCheckpointDir())


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return it without its lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()
