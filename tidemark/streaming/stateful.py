"""Windows whose parts Spark's own stream aggregation cannot put together, kept as state by cell.

A stateful processor holds, for each cell, what its open windows have gathered: sums and
extremes by variable and section of the day. A timer per window, set on its end, writes
the window when the watermark has passed it. So diurnal variables can be streamed, and
the rule that no window may be skipped is checked as samples come. Windows of the whole
run never close by themselves; ``finish_stateful`` reads them, and whatever else is
still open, out of the stream's state, not from its source.

State is a few numbers a cell, window, variable and section.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.reductions import even_share
from tidemark.operators.windows import micros, section
from tidemark.plans.diagnostics import OutputFile, Plan, _base_micros, _ends, file_begin
from tidemark.streaming.windows import _write_batch

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The window of the whole run, which no watermark passes (microseconds).
NEVER = 1 << 60
STATE_KEY = "window_end long, part int, variable int"
STATE = "total double, weight double, low double, high double, at long, latest double"


SAMPLE = ("time", "t", "end", "begin", "part", "variable", "x", "w")


def power_of(method: str) -> int:
    m = re.fullmatch(r"pow(\d+)", method)
    return 2 if method == "rms" else int(m[1]) if m else 1


class OpenWindows(StatefulProcessor):
    """State of one cell: ``(window_end, part, variable)`` to sums and extremes."""

    def __init__(self, file_name: str, methods: list[str], cells: list[str], strict: bool) -> None:
        self.file_name, self.methods, self.cells, self.strict = file_name, methods, cells, strict
        self.sections = next((int(m[7:]) for m in methods if m.startswith("diurnal")), 0)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", STATE_KEY, STATE)
        self.last = handle.getValueState("last", "window_end long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        batch.columns = [*self.cells, *SAMPLE]  # Spark hands the columns over by position
        batch = batch.sort_values(["t", "variable"], kind="stable")
        if not len(batch):
            return
        current = self.last.get()[0] if self.last.exists() else None
        begun = set()
        for end, begin in zip(batch["end"].tolist(), batch["begin"].tolist()):
            if current is not None and end < current:
                raise ValueError(f"{self.file_name}: a sample of cell {key} comes after the next window has begun")
            if self.strict and current is not None and begin > current:
                raise ValueError(f"{self.file_name}: cell {key} has skipped a window: none of its samples lies in the one after {current}")
            if end != current:
                begun.add(end)
                current = end
        self.last.update((int(current),))
        for end in begun:
            if end != NEVER:
                self.handle.registerTimer(-(-int(end) // 1000))
        for place, part in batch.groupby(["end", "part", "variable"], sort=True):
            place = tuple(int(x) for x in place)
            n = power_of(self.methods[place[2]])
            values, weights = part["x"].to_numpy(float), part["w"].to_numpy(float)
            known = ~pd.isna(values)
            values, weights, times = values[known], weights[known], part["t"].to_numpy()[known]
            plain = self.methods[place[2]] == "sum"
            total = float(((values if plain else values * weights) ** n).sum())
            held = self.open.getValue(place) if self.open.containsKey(place) else (0.0, 0.0, math.inf, -math.inf, -NEVER, math.nan)
            if len(values):
                held = (held[0] + total, held[1] + float(weights.sum()), min(held[2], float(values.min())), max(held[3], float(values.max())), int(times[-1]), float(values[-1]))
            self.open.updateValue(place, held)
        return
        yield

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        expired = expiredTimerInfo.getExpiryTimeInMs()
        closed = [(place, value) for place, value in self.open.iterator() if -(-place[0] // 1000) <= expired]
        for place, _ in closed:
            self.open.removeKey(place)
        rows = [(*key, *place, *value) for place, value in closed]
        if rows:
            yield pd.DataFrame(rows, columns=[*self.cells, "window_end", "part", "variable", "total", "weight", "low", "high", "at", "latest"])

    def close(self) -> None:
        pass


def _file(plan: Plan, name: str) -> OutputFile:
    return next(x for x in plan.files if x.name == name)


def _finished(f: OutputFile, parts: DataFrame, cells: list[str]) -> DataFrame:
    """Rows of the file from ``(cells, window_end, part, variable, total, ...)``; whole windows only."""
    diurnal = any(v.method.startswith("diurnal") for v in f.variables)
    columns = []
    for k, v in enumerate(f.variables):
        mine = lambda c, k=k: F.max(F.when(F.col("variable") == k, F.col(c)))
        total, weight = mine("total"), F.nullif(mine("weight"), F.lit(0.0))
        if v.method.startswith("diurnal"):
            columns += [F.when(weight.isNotNull(), total).alias(f"__sum_{v.output}"), weight.alias(f"__n_{v.output}")]
            continue
        mean = total / weight
        value = {
            "none": F.nanvl(mine("latest"), F.lit(None)), "min": F.when(weight.isNotNull(), mine("low")), "max": F.when(weight.isNotNull(), mine("high")),
            "sum": F.when(weight.isNotNull(), total), "rms": F.sqrt(mean),
        }.get(v.method, mean)
        columns.append(value.alias(v.output, metadata=v.attributes))
    keys = ["window_end", *cells, *(["part"] if diurnal else [])]
    out = parts.groupBy(*keys).agg(*columns)
    if diurnal:
        share = lambda v: even_share(f"`__sum_{v.output}`", f"`__n_{v.output}`", ["window_end", *cells], int(v.method[7:])).alias(v.output, metadata=v.attributes)
        out = out.select(*keys, *[share(v) if v.method.startswith("diurnal") else F.col(v.output) for v in f.variables]).withColumnRenamed("part", "section")
    return out.withColumn("window_end", F.when(F.col("window_end") != NEVER, F.col("window_end")))


def open_windows(plan: Plan, name: str, stream: DataFrame, time: str, cells: list[str], variable: str, value: str, weight: str | None = None, late: str = "0 seconds", strict: bool = True) -> DataFrame:
    """Parts of the closed windows of a plan's file, from a stream: see ``write_stateful``."""
    f = _file(plan, name)
    base, t = _base_micros(plan.base), micros(F.col(time))
    if len(f.freq) > 1 or f.freq[0] == 0:
        raise ValueError(f"{name}: windows of one frequency are held as state")
    diurnal = {int(v.method[7:]) for v in f.variables if v.method.startswith("diurnal")}
    if diurnal and (len(diurnal) > 1 or not all(v.method.startswith("diurnal") for v in f.variables)):
        raise ValueError(f"{name}: one number of diurnal sections a file, and no other variables beside them")
    rows = stream.where(F.col(variable).isin([v.name for v in f.variables])).where(t > base)
    if f.start:
        rows = rows.where(t >= _base_micros(f.start))
    for column, (low, high) in (f.region or {}).items():
        rows = rows.where(F.col(column).between(low, high))
    end = F.coalesce(_ends(f, base, t), F.lit(NEVER))
    numbers = F.explode(F.array(*[F.struct(F.lit(v.name).alias("name"), F.lit(k).alias("k")) for k, v in enumerate(f.variables)]))
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = rows.withColumns({"__end": end, "__v": numbers}).withColumn("__begin", F.lit(-NEVER) if f.freq[0] == -1 else file_begin(F.col("__end"), 0 if f.clock else base, f.freq[0]))
    rows = rows.where(F.col(variable) == F.col("__v.name")).select(
        *cells, F.col(time).cast("timestamp").alias("__time"), t.alias("__t"), "__end", F.col("__begin").cast("long").alias("__begin"),
        (section(t, next(iter(diurnal))) if diurnal else F.lit(0)).alias("__part"), F.col("__v.k").alias("__variable"), F.col(value).cast("double").alias("__x"), w.alias("__w"),  # as SAMPLE
    )
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in cells) + ", window_end long, part int, variable int, " + STATE
    processor = OpenWindows(name, [v.method for v in f.variables], cells, strict)
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return rows.withWatermark("__time", late).groupBy(*cells).transformWithStateInPandas(processor, schema, "append", "eventTime")


def write_stateful(plan: Plan, name: str, stream: DataFrame, path: str, checkpoint: str, time: str, cells: list[str], variable: str, value: str, **options):
    """Write a plan's file from a stream with its windows held as state, each when the watermark has passed its end.

    For files of diurnal variables, of the whole run, and for those that must not skip a
    window (``strict``: a cell whose samples leave out a whole window stops the stream, as
    does a sample of a window that has been left). Available data is worked off, then
    it ends; the next call goes on from the checkpoint.
    """
    f = _file(plan, name)
    parts = open_windows(plan, name, stream, time, cells, variable, value, **options)
    writer = parts.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(lambda part, batch: _write_batch(plan, name, _finished(f, part, cells), path, batch)).trigger(availableNow=True).start()


def held_state(spark: SparkSession, checkpoint: str, cells: list[str]) -> DataFrame:
    """What the stream of a checkpoint holds: ``(cells, window_end, part, variable, total, ...)``."""
    state = spark.read.format("statestore").option("stateVarName", "open").load(checkpoint)
    keys = [F.col(f"key.{c}").alias(c) for c in cells]
    return state.select(*keys, "user_map_key.*", "user_map_value.*")


def finish_stateful(plan: Plan, name: str, spark: SparkSession, path: str, checkpoint: str, cells: list[str]) -> None:
    """Write the windows that the stream still holds, the one of the whole run included, from its state.

    Call it once the stream has ended; called again it writes the same rows.
    """
    _write_batch(plan, name, _finished(_file(plan, name), held_state(spark, checkpoint, cells), cells), path, -1)
