"""Intermediate tables of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a session on one machine may leave it unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again, which cuts its lineage."""
    spark = df.sparkSession
    path = path or f"{scratch_folder(spark)}/tidemark-{uuid.uuid4().hex}"
    df.write.mode("append").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
