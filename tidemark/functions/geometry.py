"""Longitudes, edges, distances and vectors on the sphere."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tidemark.operators.regrid import great_circle

SNAP = 1e-4


def wrap_longitude(lon: Column, start: float, period: float = 360.0) -> Column:
    """``lon`` in [start, start + period); values within 1e-4 of either end become the start."""
    end = start + period
    snapped = F.when((F.abs(lon - start) < SNAP) | (F.abs(lon - end) < SNAP), F.lit(float(start))).otherwise(lon)
    return F.pmod(snapped - start, F.lit(period)) + start


def edges(keys: list[str], axis: str) -> tuple[Column, Column]:
    """Lower and upper edge of each point: midpoints, and half a cell beyond the ends."""
    order = Window.partitionBy(*keys).orderBy(axis)
    x, before, after = F.col(axis), F.lag(axis).over(order), F.lead(axis).over(order)
    low = F.when(before.isNull(), x - (after - x) / 2).otherwise((before + x) / 2)
    high = F.when(after.isNull(), x + (x - before) / 2).otherwise((x + after) / 2)
    return low, high


def vector(lon: Column, lat: Column) -> Column:
    return F.struct((F.cos(lat) * F.cos(lon)).alias("x"), (F.cos(lat) * F.sin(lon)).alias("y"), F.sin(lat).alias("z"))


def cross(a: Column, b: Column) -> Column:
    return F.struct(
        (a["y"] * b["z"] - a["z"] * b["y"]).alias("x"), (a["z"] * b["x"] - a["x"] * b["z"]).alias("y"), (a["x"] * b["y"] - a["y"] * b["x"]).alias("z")
    )


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def lon_lat(v: Column) -> tuple[Column, Column]:
    length = F.sqrt(dot(v, v))
    return F.atan2(v["y"], v["x"]), F.asin(v["z"] / length)


def box_area(lon0: Column, lon1: Column, lat0: Column, lat1: Column, radius: float) -> Column:
    return F.lit(radius * radius) * F.abs(lon1 - lon0) * F.abs(F.sin(lat1) - F.sin(lat0))


def triangle_excess(a: Column, b: Column, c: Column) -> Column:
    """Area on the unit sphere of a triangle of unit vectors."""
    triple = F.abs(dot(a, cross(b, c)))
    return 2 * F.atan2(triple, 1 + dot(a, b) + dot(b, c) + dot(c, a))


__all__ = ["box_area", "cross", "dot", "edges", "great_circle", "lon_lat", "triangle_excess", "vector", "wrap_longitude"]
