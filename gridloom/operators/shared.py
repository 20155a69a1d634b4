"""Cutting lineage in a folder that all executors reach."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset a temporary one serves a local session, on a cluster it is an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="gridloom-"))
    return context.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """A folder of one's own there."""
    return f"{shared_folder(spark)}/gridloom-{what}-{uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder as files, whose size tells Spark how to join it."""
    path = new_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
