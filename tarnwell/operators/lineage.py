"""Cutting the lineage of iterative operators, and folders for what is kept."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode, where that is unset, a temporary one."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tarnwell-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder."""
    _shared(df.sparkSession)
    return df.checkpoint(eager=True)


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"
