"""Conservative exchange between two overlapping grids, as joins over their overlap cells.

``cells(cell, side1, side2, k, area[, di, dj])``: each overlap of a cell of side 1 with
a part ``k`` of a cell of side 2. Putting a field is an equi-join, getting one is a
sum by cell divided by the cell's area.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def active(cells: DataFrame, fraction: str = "frac") -> DataFrame:
    """Overlaps with a part in use; their area is scaled by it."""
    return cells.where(F.col(fraction) != 0).withColumn("area", F.col("area") * F.col(fraction))


def put_first(cells: DataFrame, field: DataFrame, value: str, gradient: bool = False, name: str = "x") -> DataFrame:
    """Side 1's ``field(side1, value[, dx, dy])`` on the overlaps; second order with gradients."""
    x = F.col(value)
    if gradient:
        x = x + F.col("dj") * F.col("dy") + F.col("di") * F.col("dx")
    out = cells.join(field, "side1").withColumn(name, x)
    return out.select(*cells.columns, name)


def put_second(cells: DataFrame, field: DataFrame, value: str, name: str = "x") -> DataFrame:
    """Side 2's ``field(side2, k, value)`` on the overlaps."""
    return cells.join(field, ["side2", "k"]).select(*cells.columns, F.col(value).alias(name))


def get_side(cells: DataFrame, sides: DataFrame, keys: list[str], x: str = "x", area: str = "cell_area", name: str = "value") -> DataFrame:
    """Area sums of the overlaps divided by ``sides(keys, cell_area)``; 0 without overlaps."""
    total = cells.groupBy(*keys).agg(F.sum(F.col("area") * F.col(x)).alias("__total"))
    return sides.join(total, keys, "left").select(*keys, (F.coalesce(F.col("__total"), F.lit(0.0)) / F.col(area)).alias(name))


def conservation(cells: DataFrame, first: DataFrame, second: DataFrame, value: str) -> DataFrame:
    """Three totals of side 1's field: on its own cells, on side 2, and back on side 1.

    ``first(side1, cell_area, value)``, ``second(side2, k, cell_area)``.
    """
    put = put_first(cells, first.select("side1", value), value)
    direct = put.agg(F.sum(F.col("area") * F.col("x")).alias("direct"))
    there = get_side(put, second, ["side2", "k"])
    on_second = there.join(second, ["side2", "k"]).agg(F.sum(F.col("value") * F.col("cell_area")).alias("on_second"))
    back = get_side(put_second(cells, there, "value"), first.select("side1", "cell_area"), ["side1"])
    round_trip = back.join(first.select("side1", "cell_area"), "side1").agg(F.sum(F.col("value") * F.col("cell_area")).alias("round_trip"))
    return direct.crossJoin(on_second).crossJoin(round_trip)  # three aggregates of one row


def stock(df: DataFrame, keys: list[str], value: str, area: str, fraction: str, step: float, radius: float) -> DataFrame:
    """step * 4 pi radius^2 * sum of area * fraction * value."""
    total = F.sum(F.col(area) * F.col(fraction) * F.col(value)) * F.lit(step * 4 * math.pi * radius * radius)
    return df.groupBy(*keys).agg(total.alias("stock"))


def ledger(moves: DataFrame, origin: str, target: str, amount: str) -> DataFrame:
    """What each account has after its moves: taken from the origin, added to the target."""
    entries = F.array(
        F.struct(F.col(origin).alias("account"), (-F.col(amount)).alias("amount")),
        F.struct(F.col(target).alias("account"), F.col(amount).alias("amount")),
    )
    rows = moves.select(F.explode(entries).alias("e")).select("e.*")
    return rows.groupBy("account").agg(F.sum("amount").alias("balance"))


def in_region(lon: Column, lat: Column, lon_start: float, lon_end: float, lat_start: float, lat_end: float) -> Column:
    return lon.between(lon_start, lon_end) & lat.between(lat_start, lat_end)
