"""Gridded variables as Parquet: a row a cell, axes as columns, attributes as metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.fields import is_valid, unpack
from tidemark.operators.reductions import checksum, double_bits


def write_variable(df: DataFrame, path: str, value: str, attributes: dict | None = None, partition: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Write ``df`` with the attributes of its value column; append along a partition column with ``mode``."""
    df = df.withMetadata(value, attributes or {})
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def read_variable(spark: SparkSession, path: str, value: str, corner: dict[str, int] | None = None, edges: dict[str, int] | None = None, decode: bool = True) -> DataFrame:
    """A slab of a variable: from ``corner``, ``edges`` long, pushed down to the scan.

    With ``decode`` packed values are unpacked and values outside the valid range or
    equal to the fill or missing value become null, as the column's attributes say.
    Without a valid range the fill value bounds it: a positive one from above, another
    from below, itself excluded (a NaN is excluded alone).
    """
    df = spark.read.parquet(path)
    for axis, first in (corner or {}).items():
        df = df.where(F.col(axis) >= first)
        if edges and axis in edges:
            df = df.where(F.col(axis) < first + edges[axis])
    attributes = df.schema[value].metadata
    if not decode or not attributes:
        return df
    low, high = attributes.get("valid_range", (attributes.get("valid_min"), attributes.get("valid_max")))
    fill = attributes.get("_FillValue")
    fine = is_valid(F.col(value), low, high, attributes.get("missing_value"))
    if fill is not None:
        bounds = low is None and high is None and fill == fill
        fine &= F.col(value) != fill if not bounds else F.col(value) < fill if fill > 0 else F.col(value) > fill
    unpacked = unpack(F.col(value), attributes.get("scale_factor"), attributes.get("add_offset"))
    return df.withColumn(value, F.when(fine, unpacked))


def describe(df: DataFrame) -> list[tuple[str, str, dict]]:
    """Name, type and attributes of each column."""
    return [(f.name, f.dataType.simpleString(), dict(f.metadata)) for f in df.schema]


def _sums(df: DataFrame, columns: list[str]) -> DataFrame:
    """Checksums of columns: of integers their sum, of reals that of their bits, of others that of a hash."""
    kinds, sums = dict(df.dtypes), []
    for n, c in enumerate(columns):
        kind = kinds[c]
        if kind in ("double", "float"):
            df = double_bits(df.withColumn(f"__{n}", F.col(c).cast("double")), f"__{n}", f"__{n}")
            df = df.withColumn(f"__{n}", F.when(F.col(c).isNotNull(), F.col(f"__{n}")))
            sums.append(checksum(F.col(f"__{n}")).alias(c))
        elif kind in ("tinyint", "smallint", "int", "bigint"):
            sums.append(checksum(F.col(c)).alias(c))
        else:
            sums.append(checksum(F.when(F.col(c).isNotNull(), F.xxhash64(c))).alias(c))
    return df.agg(*sums)


def save_restart(df: DataFrame, path: str, columns: list[str]) -> None:
    """Write a table with the checksums of the named columns (integers, reals by their bits, others by a hash) beside it."""
    df.write.parquet(f"{path}/data")
    _sums(df.sparkSession.read.parquet(f"{path}/data"), columns).write.parquet(f"{path}/checksums")


def read_restart(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    """Read a restart; a table that does not match its checksums is an error."""
    df = spark.read.parquet(f"{path}/data")
    if verify:
        saved = spark.read.parquet(f"{path}/checksums").first().asDict()
        found = _sums(df, list(saved)).first().asDict()
        if wrong := [c for c in saved if saved[c] != found[c]]:
            raise ValueError(f"checksums differ: {', '.join(wrong)}")
    return df


def tile_path(path: str, tile: int | None = None, member: int | None = None) -> str:
    """``name[.ens_NN][.tileN].suffix``."""
    stem, dot, suffix = path.rpartition(".")
    stem, dot, suffix = (stem, dot, suffix) if dot else (suffix, "", "")
    stem += f".ens_{member:02}" if member is not None else ""
    stem += f".tile{tile}" if tile is not None else ""
    return stem + dot + suffix
