"""One front to the ways of regridding: weights by method, kept as a table, applied to fields of any rank.

Weights are rows ``(src, dst, w)``; their method is the metadata of ``w``, so that a table
that was written is applied as it was meant. Fields have further columns (levels, times)
as they like: each of their combinations is a field of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import regrid

METHODS = ("conservative", "bilinear", "bicubic", "spherical")


def make_weights(
    method: str, target: DataFrame, source: DataFrame | None = None, axes: tuple[list[float], list[float]] | None = None,
    cyclic: float | None = None, width: tuple[float, float] = (10.0, 10.0), neighbours: int = 4, radius: float = 0.1,
) -> DataFrame:
    """``src, dst, w`` from a source grid to targets.

    ``conservative`` takes boxes ``(src or dst, lon0, lon1, lat0, lat1)`` in degrees, which meet in
    bins of ``width``; ``bilinear`` and ``bicubic`` the source's ``axes`` and targets
    ``(dst, x, y)`` (one row a ``dst``), and count sources ``j * len(x axis) + i`` from 0; ``spherical`` points
    ``(src or dst, lon, lat)`` in radians, the nearest ``neighbours`` within ``radius`` by
    inverse distance.
    """
    if method == "conservative":
        out = regrid.box_overlaps(source, target, width, cyclic)
    elif method in ("bilinear", "bicubic"):
        target = target.repartition("dst")  # a row makes up to sixteen: all tasks make them, however few files targets come from
        source_id = (F.col("j").cast("long") * len(axes[0]) + F.col("i")).alias("src")
        if method == "bilinear":
            out = regrid.bilinear_weights(target, *axes, cyclic=cyclic).withColumns({"i": F.col("i") - 1, "j": F.col("j") - 1})
            out = out.groupBy(source_id, "dst").agg(F.sum("w").alias("w"))
        else:
            out = regrid.bicubic_weights(target, *axes, cyclic=cyclic).select(source_id, "dst", "w")
        out = out.where("w <> 0")
    elif method == "spherical":
        out = regrid.inverse_distance(regrid.nearest_points(source, target, neighbours, radius))
    else:
        raise ValueError(f"unknown method {method!r}: one of {', '.join(METHODS)}")
    return out.select("src", "dst", "w").withMetadata("w", {"method": method})


def write_weights(weights: DataFrame, path: str) -> None:
    weights.write.parquet(path)


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """Weights that were written, with their method; a table that names none is an error."""
    df = spark.read.parquet(path)
    if df.schema["w"].metadata.get("method") not in METHODS:
        raise ValueError(f"{path}: no method is named")
    return df


def interpolate(field: DataFrame, weights: DataFrame, value: str, missing_permit: int | None = None, target: DataFrame | None = None) -> DataFrame:
    """``field(src, ..., value)`` on the targets: ``dst``, the columns between, ``value, mask``.

    Null values and absent cells are missing. ``mask`` is the share of a target's weights
    that have a value. Conservative means are 0 where nothing has one; bilinear and
    bicubic values are null where more than ``missing_permit`` of the weighted points are
    missing (bicubic: by default where any is), spherical ones where the nearest is. With
    ``target(dst)`` targets that no source touches have rows too.
    """
    method = weights.schema["w"].metadata["method"]
    other = [c for c in field.columns if c not in ("src", value)]
    x, w = F.col(value), F.col("w")
    held = field.where(x.isNotNull())
    of = [F.count("*").alias("__of"), F.sum(w).alias("__all"), F.max(w).alias("__most")]
    there = F.when(x.isNotNull(), w)
    sums = [F.sum(x * there).alias("__x"), F.sum(there).alias("__w"), F.count(x).alias("__n"), F.max(there).alias("__near")]
    if other:
        rows = _by_level(held.join(weights, "src").groupBy("dst", *other).agg(*sums), weights.groupBy("dst").agg(*of), field.select(other), target)
    else:  # a field of one level: weights are made and go over to it once
        rows = weights.join(held, "src", "left").groupBy("dst").agg(*of, *sums)
        if target is not None:
            rows = target.select("dst").distinct().join(rows, "dst", "left")
    mean = F.col("__x") / F.nullif("__w", F.lit(0.0))
    if method == "conservative":
        out = F.coalesce(mean, F.lit(0.0))
    elif method == "spherical":
        out = F.when(F.col("__near") == F.col("__most"), mean)
    else:
        permit = missing_permit if missing_permit is not None else (0 if method == "bicubic" else None)
        out = mean if permit is None else F.when(F.col("__of") - F.col("__n") <= permit, mean)
    mask = F.coalesce(F.col("__w") / F.col("__all"), F.lit(0.0))
    return rows.select("dst", *other, out.alias(value), mask.alias("mask"))


def _by_level(sums: DataFrame, need: DataFrame, levels: DataFrame, target: DataFrame | None) -> DataFrame:
    """All targets with all combinations of a field's further columns, and their sums."""
    every = need if target is None else target.select("dst").distinct().join(need, "dst", "left")
    # the levels of a field are many fewer than its cells; Spark broadcasts them if they are small
    every = every.join(levels.distinct())
    same, renamed = F.lit(True), sums
    for c in ["dst", *levels.columns]:
        renamed = renamed.withColumnRenamed(c, f"__of_{c}")
        same = same & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    return every.join(renamed, same, "left")
