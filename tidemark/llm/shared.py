"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.

    A local session (tests) that names none gets a temporary folder; a cluster
    that names none is an error, since its machines share no local disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return context.getCheckpointDir()


def shared_table(df: DataFrame, label: str, codec: str = "zstd", by: str | None = None) -> DataFrame:
    """Write ``df`` once under the shared folder and return a reader of the copy.

    ``by`` is a column of few integers; its values become folders of the copy.

    This cuts lineage: a lost executor costs a re-read of the files, not a rerun
    of what made them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemark-{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", codec)
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def arrow_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """Jobs that run within hand at most ``n`` rows at a time to Python; the session's own setting comes back.

    For rows that hold whole texts: a batch is memory of both the executor and its worker.
    """
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(min(n, int(before)) if int(before) > 0 else n))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_ranks(df: DataFrame, order: list[Column], groups: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``rank``: the position, from 0, of each row in its group by ``order``.

    ``order`` are expressions over ``df`` that begin with the groups' own order. Rows
    are dealt by ranges and sorted within them; a position is the row's place in its
    range plus the counts of the ranges before, so no group, however large, is sorted
    in one task. Rows that tie in all of ``order`` share a range.
    """
    spark = df.sparkSession
    placed = df.repartitionByRange(parallelism(spark), *order).sortWithinPartitions(*order)
    placed = shared_table(placed.withColumn("_place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_place", 33).alias("_part")
    counts = placed.groupBy(*groups, part).agg(F.count("*").alias("_count"), F.min("_place").alias("_first"))
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_count").over(earlier), F.lit(0)))
    counts = counts.select("_first", "_before", F.col("_part").alias("_of"), *[F.col(g).alias(f"_of_{g}") for g in groups])
    same = part == F.col("_of")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    ranked = placed.join(counts, same)
    return ranked.select(*df.columns, (F.col("_place") - F.col("_first") + F.col("_before")).alias("rank"))
