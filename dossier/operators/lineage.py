"""Cutting the lineage of tables that a loop works on, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder and runs on one machine, as in tests.
FALLBACK_DIR = "/tmp/checkpoints/dossier"


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir; where it is unset, a folder of this machine in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or FALLBACK_DIR).rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for files that only this application reads."""
    return f"{shared_dir(spark)}/scratch/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The table, written reliably under spark.checkpoint.dir and read from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)
