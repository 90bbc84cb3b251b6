"""The windows of ``tidemark.operators`` over streams.

Spark's own time windows are left-closed; a sample is moved back by one microsecond
before it is assigned, which makes them right-closed at that resolution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.reductions import reduction
from tidemark.operators.windows import micros
from tidemark.plans.diagnostics import Plan, _base_micros, output, with_file_name


def reduce_stream(stream: DataFrame, time: str, cells: list[str], value: str, methods: list[str], freq: str, late: str = "0 seconds", weight: str | None = None) -> DataFrame:
    """Right-closed windows of ``freq`` per cell; a column a method, closed by the watermark.

    State is one row per open window and cell. ``none`` keeps the last sample by time.
    """
    moved = stream.withColumn("event_time", F.col(time).cast("timestamp") - F.expr("interval 1 microsecond"))
    w = F.col(weight) if weight else None
    out = moved.withWatermark("event_time", late).groupBy(F.window("event_time", freq).alias("w"), *cells)
    aggregates = [reduction(m, F.col(value), F.col(time), w).alias(m) for m in methods]
    return out.agg(*aggregates).select(F.unix_micros("w.end").alias("window_end"), *cells, *methods)


def sum_sends(stream: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Several sends of a field in one step add up before they are reduced."""
    return stream.groupBy(*keys).agg(F.sum(value).alias(value))


def write_parquet(df: DataFrame, path: str, checkpoint: str, partition: list[str] | None = None):
    """Append closed windows to Parquet; available data is worked off, then it ends."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    if partition:
        writer = writer.partitionBy(*partition)
    return writer.trigger(availableNow=True).start()


def _write_batch(plan: Plan, name: str, rows: DataFrame, path: str, batch: int) -> None:
    """One batch of an output file in a folder of its own, which a repeated batch overwrites."""
    f = next(x for x in plan.files if x.name == name)
    if f.name_freq is None:
        writer = rows.write
    else:
        writer = with_file_name(rows, f.name, f.name_freq, _base_micros(plan.base)).write.partitionBy("file")
    writer.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")


def write_plan(plan: Plan, name: str, stream: DataFrame, path: str, checkpoint: str, *columns, **options):
    """Write the closed windows of a plan's file as they come; ``columns`` and ``options`` are those of ``output``.

    Available data is worked off, then it ends; the next call goes on from the checkpoint.
    """
    rows = output(plan, name, stream, *columns, **options)
    writer = rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(lambda part, batch: _write_batch(plan, name, part, path, batch)).trigger(availableNow=True).start()


def read_plan(source: DataFrame, name: str, path: str) -> DataFrame:
    """What has been written of a file, in the session of ``source``."""
    return source.sparkSession.read.parquet(f"{path}/{name}").drop("batch")


def finish_plan(plan: Plan, name: str, source: DataFrame, path: str, time: str, *columns, **options) -> None:
    """Write the windows that the stream still holds open, from a batch read of its source.

    Windows close in order, so only samples after the last closed window's end are read;
    all of them if the stream closed none.
    Call it once the stream has ended; called again it writes the same rows.
    """
    shape = output(plan, name, source, time, *columns, **options).schema
    _write_batch(plan, name, source.sparkSession.createDataFrame([], shape), path, -1)  # the folder is there, whatever the stream wrote
    reader = source.sparkSession.read.schema(f"window_end {shape['window_end'].dataType.simpleString()}, batch int")
    last = reader.parquet(f"{path}/{name}").where("batch >= 0").agg(F.max("window_end")).first()[0]
    rest = source if last is None else source.where(micros(F.col(time)) > last)
    _write_batch(plan, name, output(plan, name, rest, time, *columns, **options), path, -1)
