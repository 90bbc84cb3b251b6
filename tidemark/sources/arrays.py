"""Chunked arrays as a Spark data source: ``spark.read.format("tidemark_array")``.

A variable over integer axes is cut into chunks. A file holds the chunks of one writing
task, compressed one by one, and at its end their index; a commit lists the files with
the ranges of each axis that they cover. A filter on an axis goes down to the scan: whole
files are left out by their ranges on the driver, chunks by the index in the task, and
of a chunk's cells only the slab becomes rows. Values may be null, and cells that were
never written are absent.

Files become visible by their commit alone: what a failed or repeated task has left
behind is never read. ``append`` adds a commit, ``overwrite`` one that hides those
before it. Paths are those of ``pyarrow.fs`` (local, hdfs, s3 and others).
"""

from __future__ import annotations

import json
import math
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

FORMAT = "tidemark_array"
CHUNK = 64
ABSENT, NULL, VALUE = 0, 1, 2
LIMITS = (-(1 << 62), 1 << 62)


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def commits(path: str) -> list[dict]:
    """Commits in their order, from the last that overwrites on."""
    system, folder = open_folder(path)
    found = system.get_file_info(fs.FileSelector(f"{folder}/commits", allow_not_found=True))
    out = []
    for info in sorted((x for x in found if x.base_name.endswith(".json")), key=lambda x: x.base_name):
        with system.open_input_stream(info.path) as stream:
            commit = json.loads(stream.read())
        out = [commit] if commit["overwrite"] else [*out, commit]
    return out


@dataclass
class Layout:
    """Axes with the length of a chunk along each, the value's name and attributes."""

    axes: list[str]
    chunk: list[int]
    value: str
    attributes: dict = field(default_factory=dict)

    @classmethod
    def of(cls, options: dict) -> Layout:
        if "axes" in options:
            axes = [a.strip() for a in options["axes"].split(",")]
            chunk = [int(c) for c in options.get("chunk", ",".join([str(CHUNK)] * len(axes))).split(",")]
            if len(chunk) != len(axes) or min(chunk) < 1:
                raise ValueError("chunk is a positive length for each axis")
            return cls(axes, chunk, options.get("value", "value"), json.loads(options.get("attributes", "{}")))
        known = commits(options["path"])
        if not known:
            raise ValueError(f"no array at {options['path']}: give its axes")
        return cls(**known[-1]["layout"])

    def schema(self) -> StructType:
        return StructType([*[StructField(a, LongType(), False) for a in self.axes], StructField(self.value, DoubleType(), metadata=self.attributes)])


class ChunkFile(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)


def read_index(stream, size: int) -> dict:
    """The index at a file's end, before its length in eight bytes."""
    stream.seek(size - 8)
    length = int.from_bytes(stream.read(8), "little")
    stream.seek(size - 8 - length)
    return json.loads(stream.read(length))


class ArrayReader(DataSourceReader):
    def __init__(self, path: str, layout: Layout) -> None:
        self.path, self.layout = path, layout
        self.slab = {a: list(LIMITS) for a in layout.axes}  # first and last of each axis
        self.members: dict[str, list[int]] = {}

    def pushFilters(self, filters: list[Filter]):
        """Ranges and lists of an axis are met here in full; other filters stay Spark's."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name not in self.slab or not self._narrow(name, f):
                yield f

    def _narrow(self, name: str, f: Filter) -> bool:
        low, high = LIMITS
        match f:
            case EqualTo(value=v):
                low = high = v
            case GreaterThan(value=v):
                low = v + 1
            case GreaterThanOrEqual(value=v):
                low = v
            case LessThan(value=v):
                high = v - 1
            case LessThanOrEqual(value=v):
                high = v
            case In(value=vs):
                known = {v for v in vs if v is not None}
                self.members[name] = sorted(known & set(self.members[name]) if name in self.members else known)
                low, high = (min(known), max(known)) if known else (1, 0)
            case _:
                return False
        self.slab[name] = [max(self.slab[name][0], low), min(self.slab[name][1], high)]
        return True

    def _meets(self, low: list[int], high: list[int]) -> bool:
        return all(self.slab[a][0] <= h and lo <= self.slab[a][1] for a, lo, h in zip(self.layout.axes, low, high))

    def partitions(self) -> list[InputPartition]:
        files = [f for c in commits(self.path) for f in c["files"]]
        return [ChunkFile(f["name"]) for f in files if self._meets(f["low"], f["high"])] or [ChunkFile("")]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not partition.value:
            return
        system, folder = open_folder(self.path)
        codec, layout = pa.Codec("zstd"), self.layout
        names = [*layout.axes, layout.value]
        with system.open_input_file(f"{folder}/data/{partition.value}") as stream:
            for entry in read_index(stream, stream.size())["chunks"]:
                low = [c * n for c, n in zip(entry["at"], layout.chunk)]
                high = [x + n - 1 for x, n in zip(low, layout.chunk)]
                if not self._meets(low, high):
                    continue
                stream.seek(entry["offset"])
                cells = math.prod(layout.chunk)
                raw = codec.decompress(stream.read(entry["length"]), 9 * cells, asbytes=True)
                values = np.frombuffer(raw, np.float64, cells).reshape(layout.chunk)
                state = np.frombuffer(raw, np.uint8, cells, 8 * cells).reshape(layout.chunk)
                begin = [max(0, self.slab[a][0] - x) for a, x in zip(layout.axes, low)]
                part = tuple(slice(b, min(n, self.slab[a][1] - x + 1)) for a, b, n, x in zip(layout.axes, begin, layout.chunk, low))
                held = state[part] != ABSENT
                at = [i + b + x for i, b, x in zip(np.nonzero(held), begin, low)]
                keep = np.ones(len(at[0]), bool)
                for a, i in zip(layout.axes, at):
                    if a in self.members:
                        keep &= np.isin(i, self.members[a])
                value = pa.array(values[part][held][keep], mask=(state[part][held] == NULL)[keep])
                if len(value):
                    yield pa.RecordBatch.from_arrays([*[pa.array(i[keep].astype(np.int64)) for i in at], value], names=names)


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    low: list[int]
    high: list[int]


class ArrayWriter(DataSourceArrowWriter):
    def __init__(self, path: str, layout: Layout, overwrite: bool) -> None:
        self.path, self.layout, self.overwrite = path, layout, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """One file of the task's chunks; one chunk is held at a time while rows come sorted by chunk."""
        system, folder = open_folder(self.path)
        system.create_dir(f"{folder}/data", recursive=True)
        layout, codec = self.layout, pa.Codec("zstd")
        name = f"{uuid.uuid4().hex}.chunks"
        lengths = np.array(layout.chunk)
        entries, at, values, state, offset = [], None, None, None, 0
        with system.open_output_stream(f"{folder}/data/{name}") as stream:

            def put() -> None:
                nonlocal offset
                packed = codec.compress(values.tobytes() + state.tobytes(), asbytes=True)
                entries.append({"at": [int(x) for x in at], "offset": offset, "length": len(packed)})
                stream.write(packed)
                offset += len(packed)

            for batch in iterator:
                index = np.stack([batch.column(a).to_numpy(zero_copy_only=False) for a in layout.axes], 1).astype(np.int64)
                column = batch.column(layout.value).cast(pa.float64())
                null = np.asarray(column.is_null())
                cells = column.fill_null(0.0).to_numpy(zero_copy_only=False)
                chunk = index // lengths
                cuts = np.flatnonzero((chunk[1:] != chunk[:-1]).any(1)) + 1
                for rows in np.split(np.arange(len(index)), cuts) if len(index) else ():
                    if at is None or (chunk[rows[0]] != at).any():
                        if at is not None:
                            put()
                        at, values, state = chunk[rows[0]], np.zeros(layout.chunk), np.zeros(layout.chunk, np.uint8)
                    place = tuple((index[rows] - at * lengths).T)
                    values[place], state[place] = cells[rows], np.where(null[rows], NULL, VALUE)
            if at is not None:
                put()
            footer = json.dumps({"chunks": entries}).encode()
            stream.write(footer + len(footer).to_bytes(8, "little"))
        if not entries:
            system.delete_file(f"{folder}/data/{name}")
            return Written(None, [], [])
        where = np.array([e["at"] for e in entries])
        return Written(name, (where.min(0) * lengths).tolist(), ((where.max(0) + 1) * lengths - 1).tolist())

    def commit(self, messages: list) -> None:
        system, folder = open_folder(self.path)
        system.create_dir(f"{folder}/commits", recursive=True)
        known = [int(posixpath.basename(x.path).split("-")[0]) for x in system.get_file_info(fs.FileSelector(f"{folder}/commits")) if x.base_name.endswith(".json")]
        files = [{"name": m.name, "low": m.low, "high": m.high} for m in messages if m and m.name]
        body = {"overwrite": self.overwrite, "layout": vars(self.layout), "files": files}
        target = f"{folder}/commits/{max(known, default=0) + 1:09}-{uuid.uuid4().hex}"
        with system.open_output_stream(f"{target}.tmp") as stream:
            stream.write(json.dumps(body).encode())
        system.move(f"{target}.tmp", f"{target}.json")  # visible at once or not at all

    def abort(self, messages: list) -> None:
        system, folder = open_folder(self.path)
        for m in messages:
            if m and m.name:
                system.delete_file(f"{folder}/data/{m.name}")


class ArraySource(DataSource):
    """Options: ``path``; to write ``axes`` and ``chunk`` (comma-separated), ``value``, ``attributes`` (JSON)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return Layout.of(self.options).schema()

    def reader(self, schema: StructType) -> ArrayReader:
        known = commits(self.options["path"])
        return ArrayReader(self.options["path"], Layout(**known[-1]["layout"]) if known else Layout.of(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> ArrayWriter:
        layout = Layout.of(self.options)
        known = [] if overwrite else commits(self.options["path"])
        if known and known[-1]["layout"] != vars(layout):
            raise ValueError("an array keeps its axes, chunks, value and attributes as it grows")
        return ArrayWriter(self.options["path"], layout, overwrite)


def use_arrays(spark: SparkSession) -> None:
    """Make the format known to a session, filters included."""
    spark.dataSource.register(ArraySource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_array(df: DataFrame, path: str, axes: list[str], value: str, chunk: list[int], mode: str = "append", attributes: dict | None = None) -> None:
    """Write ``df(axes, value)``, one row a cell; of rows of one cell in a chunk the last one stays.

    Rows are dealt by chunk and sorted by chunk within a task, so that every chunk is
    written once and a task holds one of them at a time. A null axis is an error.
    """
    spark = df.sparkSession
    use_arrays(spark)
    place = lambda a: F.coalesce(F.col(a).cast("long"), F.raise_error(F.lit(f"a cell has no {a}")).cast("long")).alias(a)
    df = df.select(*[place(a) for a in axes], F.col(value).cast("double").alias(value))
    chunks = [F.floor(F.col(a) / n) for a, n in zip(axes, chunk)]
    df = df.repartition(*chunks).sortWithinPartitions(*chunks)
    options = {"axes": ",".join(axes), "chunk": ",".join(map(str, chunk)), "value": value, "attributes": json.dumps(attributes or {})}
    df.write.format(FORMAT).options(**options).mode(mode).save(path)


def read_array(spark: SparkSession, path: str, corner: dict[str, int] | None = None, edges: dict[str, int] | None = None) -> DataFrame:
    """An array as rows, or the slab from ``corner`` on that is ``edges`` long, cut out in the scan."""
    use_arrays(spark)
    df = spark.read.format(FORMAT).load(path)
    for axis, first in (corner or {}).items():
        df = df.where(F.col(axis) >= first)
        if edges and axis in edges:
            df = df.where(F.col(axis) < first + edges[axis])
    return df
