"""Operations on neighbouring cells: shifted joins, gradients, nests, fills."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.tables import checkpointed


def shifted(df: DataFrame, keys: list[str], axis: str, by: int, value: str, name: str, period: int | None = None) -> DataFrame:
    """``df`` with the value ``by`` cells along ``axis``; with a period (cells 0..period-1) around its end."""
    place = F.col(axis) - by
    place = F.pmod(place, F.lit(period)) if period else place
    other = df.select(*[F.col(k) for k in keys], place.alias(axis), F.col(value).alias(name))
    return df.join(other, [*keys, axis], "left")


def centred_gradient(keys: list[str], axis: str, value: str, spacing: Column | float = 1.0) -> Column:
    """Centred difference along an axis, one-sided at its ends. One sort, no join."""
    order = Window.partitionBy(*keys).orderBy(axis)
    after, before, x = F.lead(value).over(order), F.lag(value).over(order), F.col(value)
    spacing = F.lit(spacing) if not isinstance(spacing, Column) else spacing
    inner = (after - before) / (spacing * 2)
    return F.when(before.isNull(), (after - x) / spacing).when(after.isNull(), (x - before) / spacing).otherwise(inner)


def gradient_lon_lat(df: DataFrame, keys: list[str], i: str, j: str, value: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """``df`` with ``east`` and ``north``: slopes on the unit sphere, centred, one-sided at the ends of both axes.

    Points of one row (``j``) or column (``i``) are taken in order, whatever their steps, in
    radians; longitudes wrap. A row or column of one point, and a pole's ``east``, are null.
    """

    def step(order, column: str) -> Column:
        return F.coalesce(F.lead(column).over(order), F.col(column)) - F.coalesce(F.lag(column).over(order), F.col(column))

    along, across = Window.partitionBy(*keys, j).orderBy(i), Window.partitionBy(*keys, i).orderBy(j)
    turn = 2 * math.pi
    width = step(along, lon)
    width = width - F.when(width > math.pi, turn).when(width < -math.pi, -turn).otherwise(0.0)
    level = F.cos(lat)
    east = step(along, value) / F.when((width != 0) & (F.abs(level) > 1e-10), width * level)
    return df.withColumns({"east": east, "north": step(across, value) / F.nullif(step(across, lat), F.lit(0.0))})


def is_monotonic(df: DataFrame, keys: list[str], axis: str, value: str) -> DataFrame:
    """Whether values strictly rise or strictly fall along an axis."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(axis))
    rows = df.withColumn("__step", step)
    rising, falling = F.coalesce(F.col("__step") > 0, F.lit(True)), F.coalesce(F.col("__step") < 0, F.lit(True))
    return rows.groupBy(*keys).agg((F.bool_and(rising) | F.bool_and(falling)).alias("monotonic"))


def coarsen(df: DataFrame, keys: list[str], axes: list[str], refine: int, value: str, how: str = "avg") -> DataFrame:
    """Means (or ``sum``, ``min``, ``max``) of ``refine`` fine cells along each axis (cells from 0)."""
    coarse = [F.floor(F.col(a) / refine).cast("long").alias(a) for a in axes]
    aggregate = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max}[how]
    return df.groupBy(*keys, *coarse).agg(aggregate(value).alias(value), F.count(value).alias("n"))


def refine(coarse: DataFrame, fine: DataFrame, keys: list[str], axes: list[str], by: int, value: str) -> DataFrame:
    """Each fine cell with its coarse cell's value."""
    placed = fine.select("*", *[F.floor(F.col(a) / by).cast("long").alias(f"__{a}") for a in axes])
    other = coarse.select(*keys, *[F.col(a).alias(f"__{a}") for a in axes], F.col(value))
    return placed.join(other, [*keys, *[f"__{a}" for a in axes]], "left").drop(*[f"__{a}" for a in axes])


def across_contacts(df: DataFrame, contacts: DataFrame, value: str, name: str = "neighbour") -> DataFrame:
    """Values across tile edges: ``contacts(tile, i, j, to_tile, to_i, to_j, sign)`` lists halo cells."""
    other = df.select(F.col("tile").alias("to_tile"), F.col("i").alias("to_i"), F.col("j").alias("to_j"), F.col(value).alias(name))
    out = contacts.join(other, ["to_tile", "to_i", "to_j"], "left")
    return out.select("tile", "i", "j", (F.col(name) * F.col("sign")).alias(name))


def flood_fill(cells: DataFrame, i: str, j: str, percent: str, seed: float, critical: float, period: int | None = None) -> DataFrame:
    """Cells ``(i, j)`` reached from those over ``seed`` through the 8 neighbours over ``critical``.

    Each round joins the last round's new cells only, and is written to the shared
    folder; rounds are as many as the longest way.
    """
    spark = cells.sparkSession
    open_cells = checkpointed(cells.where(F.col(percent) > critical).select(i, j))
    front = checkpointed(cells.where(F.col(percent) > seed).select(i, j))
    reached = front
    steps = spark.createDataFrame([(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b], "di int, dj int")
    while front.limit(1).count():
        place = F.col(i) + F.col("di")
        place = F.pmod(place, F.lit(period)) if period else place
        around = front.crossJoin(F.broadcast(steps)).select(place.cast("long").alias(i), (F.col(j) + F.col("dj")).cast("long").alias(j)).distinct()  # 8 steps
        front = checkpointed(around.join(open_cells, [i, j], "left_semi").join(reached, [i, j], "left_anti"))
        reached = checkpointed(reached.unionByName(front))
    return reached


def fill_gaps(df: DataFrame, keys: list[str], i: str, j: str, value: str, extent: tuple[tuple[int, int], tuple[int, int]], passes: int | None = None) -> DataFrame:
    """Null cells as means of the known cells among their eight neighbours, pass by pass.

    A cell with one known neighbour waits if that is a corner of the three-by-three
    block, cut off at ``extent`` (first and last ``i``, first and last ``j``); or constants
    would spread diagonally. Ends after ``passes``, or when a pass fills nothing; cells no
    value reaches stay null. Only null cells are spread to their neighbours, and each
    pass is written to the shared folder.
    """
    steps = df.sparkSession.createDataFrame([(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b], "di int, dj int")
    cell = [*keys, i, j]

    def at_corner(mine: str, theirs: str, ends: tuple[int, int]) -> Column:
        low, high = F.greatest(F.col(mine) - 1, F.lit(ends[0])), F.least(F.col(mine) + 1, F.lit(ends[1]))
        return (F.col(theirs) == low) | (F.col(theirs) == high)

    known = df.where(F.col(value).isNotNull()).select(*cell, value)
    blank = checkpointed(df.where(F.col(value).isNull()).select(*cell))
    done = 0
    while passes is None or done < passes:
        around = blank.crossJoin(F.broadcast(steps))  # 8 steps
        around = around.select(*cell, (F.col(i) + F.col("di")).alias("__i"), (F.col(j) + F.col("dj")).alias("__j"))
        near = known.select(*keys, F.col(i).alias("__i"), F.col(j).alias("__j"), F.col(value).alias("__x"))
        met = around.join(near, [*keys, "__i", "__j"]).groupBy(*cell).agg(
            F.avg("__x").alias(value), F.count("*").alias("__n"), F.max("__i").alias("__i"), F.max("__j").alias("__j")
        )
        corner = at_corner(i, "__i", extent[0]) & at_corner(j, "__j", extent[1])
        new = checkpointed(met.where((F.col("__n") > 1) | ~corner).select(*cell, value))
        if new.isEmpty():
            break
        known, blank = checkpointed(known.unionByName(new)), checkpointed(blank.join(new, cell, "left_anti"))
        done += 1
    return known.unionByName(blank.select(*cell, F.lit(None).cast(df.schema[value].dataType).alias(value)))


def inverse_permutation(df: DataFrame, keys: list[str], position: str, target: str) -> DataFrame:
    """``position`` and ``target`` exchanged; a target given twice is an error."""
    twice = F.count("*").over(Window.partitionBy(*keys, target)) > 1
    checked = F.when(twice, F.raise_error(F.lit("not a permutation"))).otherwise(F.col(position))
    return df.select(*keys, F.col(target).alias(position), checked.alias(target))


def per_column(df: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """A recurrence along one column at a time; a column has as many rows as levels."""
    return df.groupBy(*keys).applyInPandas(fn, schema)


def spline(df: DataFrame, targets: DataFrame, keys: list[str], slopes: tuple[float | None, float | None] = (None, None)) -> DataFrame:
    """Cubic spline of ``df(keys, x, y)`` at ``targets(keys, at)``: ``keys, at, value``.

    ``slopes`` are those at both ends; where there is none the spline is natural, without
    curvature at that end. Beyond the ends the last cubic goes on. Of one point all values
    are its own, of none null; points repeated or without a value are an error.
    """
    import numpy as np

    def solve(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a = a.sort_values("x")
        x, y = a["x"].to_numpy(float), a["y"].to_numpy(float)
        n = len(x)
        at = b["at"].to_numpy(float)
        if n < 2:
            return b.assign(value=y[0] if n else np.nan)
        h = np.diff(x)
        if not (h > 0).all() or np.isnan(y).any():
            raise ValueError(f"{key}: points of a spline are distinct and have values")
        rise = np.diff(y) / h
        lower, diagonal, upper, rhs = np.zeros(n), np.ones(n), np.zeros(n), np.zeros(n)
        lower[1:-1], diagonal[1:-1], upper[1:-1], rhs[1:-1] = h[:-1] / 6, (h[:-1] + h[1:]) / 3, h[1:] / 6, np.diff(rise)
        if slopes[0] is not None:
            diagonal[0], upper[0], rhs[0] = h[0] / 3, h[0] / 6, rise[0] - slopes[0]
        if slopes[1] is not None:
            lower[-1], diagonal[-1], rhs[-1] = h[-1] / 6, h[-1] / 3, slopes[1] - rise[-1]
        second = thomas(lower, diagonal, upper, rhs)
        k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
        h = x[k + 1] - x[k]
        p, q = (x[k + 1] - at) / h, (at - x[k]) / h
        value = p * y[k] + q * y[k + 1] + ((p**3 - p) * second[k] + (q**3 - q) * second[k + 1]) * h * h / 6
        return b.assign(value=value)

    kinds = dict(targets.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in targets.columns) + ", value double"
    return df.groupBy(*keys).cogroup(targets.groupBy(*keys)).applyInPandas(solve, schema)


def thomas(lower, diagonal, upper, rhs):
    """Solve a tridiagonal system; ``lower[0]`` and ``upper[-1]`` are not used."""
    import numpy as np

    n = len(rhs)
    ratio, part = np.zeros(n), np.zeros(n)
    for k in range(n):
        under = lower[k] if k else 0.0
        pivot = diagonal[k] - under * (ratio[k - 1] if k else 0.0)
        ratio[k] = upper[k] / pivot if k < n - 1 else 0.0
        part[k] = (rhs[k] - under * (part[k - 1] if k else 0.0)) / pivot
    for k in range(n - 2, -1, -1):
        part[k] -= ratio[k] * part[k + 1]
    return part


def tridiagonal(df: DataFrame, keys: list[str], level: str = "k") -> DataFrame:
    """Solve a system per column: rows ``(keys, k, a, b, c, d)`` to ``keys, k, x``."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(level)
        x = thomas(*[rows[c].to_numpy(float) for c in ("c", "b", "a", "d")])
        return rows[[*keys, level]].assign(x=x)

    kinds = dict(df.dtypes)
    return df.groupBy(*keys).applyInPandas(solve, ", ".join(f"{c} {kinds[c]}" for c in [*keys, level]) + ", x double")


def push(particles: DataFrame, fields: list[tuple[str, str]], shape: list[int], velocity: DataFrame, step: float) -> DataFrame:
    """One Runge-Kutta step of ``particles(id, *axes)`` through a gridded velocity.

    ``fields`` pairs each axis with its velocity column; ``velocity(cell, columns)``
    numbers grid nodes row-major. Each of the four stages looks up the corners of the
    particles' cells by join (n-linear), moves them and is checkpointed, since the next
    stage and the result both use it; particles that leave are dropped.
    """
    axes = [a for a, _ in fields]
    start = checkpointed(particles.select("id", *axes))
    total, at = None, start
    for share, next_part in ((1, 0.5), (2, 0.5), (2, 1.0), (1, None)):
        k = checkpointed(_velocity_at(at, fields, shape, velocity, step))
        moved = {a: F.col(f"__k_{a}") for a in axes}
        part = k.select("id", *[(moved[a] * share).alias(f"__s_{a}") for a in axes])
        total = part if total is None else total.join(part.toDF("id", *[f"__t_{a}" for a in axes]), "id").select(
            "id", *[(F.col(f"__s_{a}") + F.col(f"__t_{a}")).alias(f"__s_{a}") for a in axes]
        )
        if next_part is not None:
            at = start.join(k.select("id", *[f"__k_{a}" for a in axes]), "id").select("id", *[(F.col(a) + moved[a] * next_part).alias(a) for a in axes])
    out = start.join(total, "id").select("id", *[(F.col(a) + F.col(f"__s_{a}") / 6).alias(a) for a in axes])
    for a, n in zip(axes, shape):
        out = out.where(F.col(a).between(0, n - 1))
    return out


def _velocity_at(at: DataFrame, fields: list[tuple[str, str]], shape: list[int], velocity: DataFrame, step: float) -> DataFrame:
    axes = [a for a, _ in fields]
    corners = F.array(F.struct(F.lit(0).cast("long").alias("cell"), F.lit(1.0).alias("w")))
    rows = at
    for a, n in zip(axes, shape):
        low = F.greatest(F.lit(0), F.least(F.floor(F.col(a)), F.lit(n - 2))).cast("long")
        rows = rows.where(F.col(a).between(0, n - 1)).withColumn(f"__low_{a}", low).withColumn(f"__part_{a}", F.col(a) - low)
    for a, n in zip(axes, shape):
        corners = _along_axis(corners, F.col(f"__low_{a}"), F.col(f"__part_{a}"), n)
    rows = rows.select("id", F.explode(corners).alias("c")).select("id", "c.cell", "c.w")
    joined = rows.join(velocity, "cell")
    return joined.groupBy("id").agg(*[(F.sum(F.col(v) * F.col("w")) * step).alias(f"__k_{a}") for a, v in fields])


def _along_axis(corners: Column, low: Column, part: Column, n: int) -> Column:
    """Both neighbours along one more axis of each corner, with their weights."""
    return F.flatten(F.transform(corners, lambda c: F.array(
        F.struct((c["cell"] * n + low).alias("cell"), (c["w"] * (1 - part)).alias("w")),
        F.struct((c["cell"] * n + low + 1).alias("cell"), (c["w"] * part).alias("w")),
    )))
