"""Regridding as joins: weights are rows ``(src, dst, w)`` and applying them is a group-by."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import constants, points_upto


def apply_weights(field: DataFrame, weights: DataFrame, source: list[str], target: list[str], value: str, weight: str = "w", missing_permit: int | None = None, corners: int = 4, name: str = "value") -> DataFrame:
    """Weighted means of valid source cells per target cell.

    With ``missing_permit``, a target with more missing corners than that is null; null
    values and absent cells are missing. Spark broadcasts the weights only if they are
    small; else both sides meet by source cell.
    """
    x = weights.join(field, source, "left")
    w = F.when(F.col(value).isNotNull(), F.col(weight))
    out = x.groupBy(*target).agg((F.sum(F.col(value) * w) / F.nullif(F.sum(w), F.lit(0.0))).alias(name), F.count(value).alias("__valid"))
    if missing_permit is not None:
        out = out.withColumn(name, F.when(F.lit(corners) - F.col("__valid") <= missing_permit, F.col(name)))
    return out.drop("__valid")


def overlaps(source: DataFrame, target: DataFrame, width: float, period: float | None = None) -> DataFrame:
    """Pairs of overlapping intervals ``(src, lo, hi)`` and ``(dst, lo, hi)`` with their length ``w``.

    With a ``period`` (360 degrees) intervals are the same whatever whole periods they are
    moved by; what a pair shares in several places adds up.

    Intervals are put in bins of ``width`` and meet by bin, so the range condition is
    checked within bins; a pair is kept in the bin where the overlap begins.
    """
    if period is not None:
        # sources begin in [0, period), targets too; both reach up to a period further
        turned = lambda df, name: df.select(name, F.pmod("lo", F.lit(float(period))).alias("lo"), (F.pmod("lo", F.lit(float(period))) + F.col("hi") - F.col("lo")).alias("hi"))
        copies = turned(source, "src").withColumn("turn", F.explode(F.array(*[F.lit(k * float(period)) for k in (-1, 0, 1)])))
        copies = copies.select("src", (F.col("lo") + F.col("turn")).alias("lo"), (F.col("hi") + F.col("turn")).alias("hi"))
        return overlaps(copies, turned(target, "dst"), width).groupBy("src", "dst").agg(F.sum("w").alias("w"))

    def binned(df: DataFrame, name: str) -> DataFrame:
        first, last = F.floor(F.col("lo") / width), F.floor(F.col("hi") / width)
        return df.select(F.col(name), F.col("lo").alias(f"{name}_lo"), F.col("hi").alias(f"{name}_hi"), F.explode(F.sequence(first, last)).alias("bin"))

    pairs = binned(source, "src").join(binned(target, "dst"), "bin")
    low, high = F.greatest("src_lo", "dst_lo"), F.least("src_hi", "dst_hi")
    return pairs.where((low < high) & (F.floor(low / width) == F.col("bin"))).select("src", "dst", (high - low).alias("w"))


def sine_latitude(df: DataFrame, low: str = "lo", high: str = "hi") -> DataFrame:
    """Latitude edges in degrees to sines, in which overlap lengths are areas."""
    return df.withColumn(low, F.sin(F.radians(low))).withColumn(high, F.sin(F.radians(high)))


def conserve(field: DataFrame, source: DataFrame, target: DataFrame, value: str, width: float, mask: Column | None = None, period: float | None = None) -> DataFrame:
    """Conservative means on target intervals: ``dst, value, mask_out``; 0 where nothing is valid.

    Every target has a row, also one that no source touches.
    """
    m = F.when(F.col(value).isNotNull() & (mask if mask is not None else F.lit(True)), F.lit(1.0)).otherwise(F.lit(0.0))
    rows = overlaps(source, target, width, period).join(field, "src").withColumn("m", m)
    out = rows.groupBy("dst").agg(
        F.sum(F.coalesce(F.col(value), F.lit(0.0)) * F.col("w") * F.col("m")).alias("x"), F.sum(F.col("w") * F.col("m")).alias("am"), F.sum("w").alias("a")
    )
    return _means(target.select("dst").join(out, "dst", "left"))


def _means(sums: DataFrame) -> DataFrame:
    """``dst, value, mask_out`` from sums ``x`` and valid area ``am`` of area ``a``, null where nothing overlaps."""
    value = F.when(F.col("am") > 0, F.col("x") / F.col("am")).otherwise(0.0)
    return sums.select("dst", value.alias("value"), F.coalesce(F.col("am") / F.col("a"), F.lit(0.0)).alias("mask_out"))


def conserve_deviation(field: DataFrame, source: DataFrame, target: DataFrame, value: str, width: float) -> DataFrame:
    """Standard deviation inside target intervals: sqrt(max(0, mean of squares - square of mean))."""
    rows = overlaps(source, target, width).join(field, "src")
    v, w = F.col(value), F.col("w")
    out = rows.groupBy("dst").agg((F.sum(v * w) / F.sum(w)).alias("mean"), (F.sum(v * v * w) / F.sum(w)).alias("square"))
    return out.select("dst", F.sqrt(F.greatest(F.lit(0.0), F.col("square") - F.col("mean") * F.col("mean"))).alias("deviation"))


def box_overlaps(source: DataFrame, target: DataFrame, width: tuple[float, float], period: float | None = 360.0) -> DataFrame:
    """Overlap areas of longitude-latitude boxes: ``(src, dst, w)``.

    Boxes are ``(src or dst, lon0, lon1, lat0, lat1)`` in degrees. They meet in bins of
    ``width`` degrees of longitude and latitude; ``w`` is the shared area on the unit
    sphere. Longitudes wrap by ``period``.
    """

    def binned(df: DataFrame, name: str) -> DataFrame:
        cut = lambda c, n: F.floor(F.col(c) / width[n])
        df = df.select(name, *[F.col(c).alias(f"{name}_{c}") for c in ("lon0", "lon1", "lat0", "lat1")], "lon0", "lon1", "lat0", "lat1")
        df = df.withColumn("bx", F.explode(F.sequence(cut("lon0", 0), cut("lon1", 0)))).withColumn("by", F.explode(F.sequence(cut("lat0", 1), cut("lat1", 1))))
        return df.drop("lon0", "lon1", "lat0", "lat1")

    if period is not None:
        span, begin = F.col("lon1") - F.col("lon0"), F.pmod("lon0", F.lit(float(period)))
        turned = lambda df: df.withColumn("__s", span).withColumn("lon0", begin).withColumn("lon1", F.col("lon0") + F.col("__s")).drop("__s")
        source, target = turned(source), turned(target)
        source = source.withColumn("__k", F.explode(F.array(*[F.lit(k * float(period)) for k in (-1, 0, 1)])))
        source = source.withColumn("lon0", F.col("lon0") + F.col("__k")).withColumn("lon1", F.col("lon1") + F.col("__k")).drop("__k")
    pairs = binned(source, "src").join(binned(target, "dst"), ["bx", "by"])
    west, east = F.greatest("src_lon0", "dst_lon0"), F.least("src_lon1", "dst_lon1")
    south, north = F.greatest("src_lat0", "dst_lat0"), F.least("src_lat1", "dst_lat1")
    here = (F.floor(west / width[0]) == F.col("bx")) & (F.floor(south / width[1]) == F.col("by"))
    area = F.radians(east - west) * (F.sin(F.radians(north)) - F.sin(F.radians(south)))
    found = pairs.where((west < east) & (south < north) & here).select("src", "dst", area.alias("w"))
    return found.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def conserve_boxes(field: DataFrame, overlap: DataFrame, value: str, mask: str | None = None, target: DataFrame | None = None) -> DataFrame:
    """Conservative means over overlaps ``(src, dst, w)``: ``dst, value, mask_out``; 0 where nothing is valid.

    A cell that ``field`` lacks is not valid. With ``target(dst)`` every target has a row,
    also one that no source touches.
    """
    m = F.when(F.col(value).isNotNull(), F.col(mask).cast("double") if mask else F.lit(1.0)).otherwise(0.0)
    rows = overlap.join(field, "src", "left").withColumn("m", m)
    sums = rows.groupBy("dst").agg(F.sum(F.coalesce(F.col(value), F.lit(0.0)) * F.col("w") * F.col("m")).alias("x"), F.sum(F.col("w") * F.col("m")).alias("am"), F.sum("w").alias("a"))
    return _means(sums if target is None else target.select("dst").join(sums, "dst", "left"))


def land_fraction(field: DataFrame, overlap: DataFrame, value: str) -> DataFrame:
    """Area-mean, standard deviation and ocean fraction of a topography: ``dst, mean, deviation, ocean_frac, ocean``.

    The ocean is where ``value`` is under zero; ``ocean`` is whether it is over half.
    """
    rows = overlap.join(field.where(F.col(value).isNotNull()), "src")
    v, w = F.col(value), F.col("w")
    sums = rows.groupBy("dst").agg(F.sum(v * w).alias("x"), F.sum(v * v * w).alias("xx"), F.sum(F.when(v < 0, w).otherwise(0.0)).alias("o"), F.sum(w).alias("a"))
    mean, square, ocean = (F.col(c) / F.col("a") for c in ("x", "xx", "o"))
    spread = F.sqrt(F.greatest(F.lit(0.0), square - mean * mean))
    return sums.select("dst", mean.alias("mean"), spread.alias("deviation"), ocean.alias("ocean_frac"), (ocean > 0.5).alias("ocean"))


def bracket(axis: list[float], value: Column, cyclic: float | None = None, upto: Column | None = None) -> tuple[Column, Column, Column]:
    """Lower and upper 1-based index and the upper weight; beyond the ends the nearest point.

    With a period the gap between last and first is an interval too. The axis is a list
    on the driver (a grid's axis); it is one array in the plan, searched by halving.
    ``upto`` is ``points_upto`` where it is a column already.
    """
    n, points = len(axis), constants(axis)
    upto = points_upto(axis, value) if upto is None else upto
    inside = (upto >= 1) & (upto < n)
    low = F.when(upto < 1, n if cyclic is not None else 1).otherwise(upto)
    high = F.when(inside, upto + 1).otherwise(1 if cyclic is not None else low)
    a, b = F.element_at(points, F.greatest(low, F.lit(1))), F.element_at(points, F.greatest(high, F.lit(1)))
    w = F.when(inside, (value - a) / (b - a))
    if cyclic is None:
        return low, high, w.otherwise(0.0)
    gap = axis[0] + cyclic - axis[-1]
    return low, high, w.otherwise(F.when(upto >= n, (value - axis[-1]) / gap).otherwise((value + cyclic - axis[-1]) / gap))


def is_separable(cells: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, separable``: longitudes of ``cells(keys, i, j, lon, lat)`` by ``i`` alone, latitudes by ``j`` alone."""
    rows = cells.groupBy(*keys, "j").agg((F.min("lat") == F.max("lat")).alias("one"))
    columns = cells.groupBy(*keys, "i").agg((F.min("lon") == F.max("lon")).alias("one"))
    return rows.select(*keys, "one").unionByName(columns.select(*keys, "one")).groupBy(*keys).agg(F.bool_and("one").alias("separable"))


def bilinear_weights(points: DataFrame, x_axis: list[float], y_axis: list[float], x: str = "x", y: str = "y", target: str = "dst", cyclic: float | None = None) -> DataFrame:
    """Four rows ``(dst, i, j, w)`` a point of a rectilinear grid."""
    i0, i1, wx = bracket(x_axis, F.col(x), cyclic, F.col("__ux"))
    j0, j1, wy = bracket(y_axis, F.col(y), None, F.col("__uy"))
    df = points.withColumns({"__ux": points_upto(x_axis, F.col(x)), "__uy": points_upto(y_axis, F.col(y))}).select(target, i0.alias("i0"), i1.alias("i1"), wx.alias("wx"), j0.alias("j0"), j1.alias("j1"), wy.alias("wy"))
    corner = lambda i, j, a, b: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), (a * b).alias("w"))
    east, north = F.col("wx"), F.col("wy")
    corners = F.array(corner("i0", "j0", 1 - east, 1 - north), corner("i1", "j0", east, 1 - north), corner("i1", "j1", east, north), corner("i0", "j1", 1 - east, north))
    return df.select(target, F.explode(corners).alias("c")).select(target, "c.*")


def bilinear_near(field: DataFrame, points: DataFrame, x_axis: list[float], y_axis: list[float], value: str, cyclic: float | None = None) -> DataFrame:
    """Bilinear values that keep to what is near where corners are missing: ``dst, value``.

    ``field(i, j, value)`` is on the axes' points, from 0; null and absent points are
    missing. ``points(dst, x, y)``. A cell of four corners is bilinear as a whole. Else its
    quadrants are: a quadrant is missing if its own corner is (on a line between quadrants
    any of their corners); its other points are the middles of the cell's sides (or the
    corner, where the side's other end is missing) and of the cell, which is the mean of
    the corners that are left, of three those of the whole diagonal.
    """
    i0, i1, wx = bracket(x_axis, F.col("x"), cyclic, F.col("__ux"))
    j0, j1, wy = bracket(y_axis, F.col("y"), None, F.col("__uy"))
    df = points.withColumns({"__ux": points_upto(x_axis, F.col("x")), "__uy": points_upto(y_axis, F.col("y"))})
    df = df.select("dst", i0.alias("i0"), i1.alias("i1"), wx.alias("wx"), j0.alias("j0"), j1.alias("j1"), wy.alias("wy"))
    corner = lambda a, b: F.struct(F.lit(2 * b + a).alias("c"), (F.col(f"i{a}") - 1).cast("long").alias("i"), (F.col(f"j{b}") - 1).cast("long").alias("j"))
    met = df.withColumn("at", F.explode(F.array(corner(0, 0), corner(1, 0), corner(0, 1), corner(1, 1)))).select("dst", "wx", "wy", "at.*")
    held = field.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col(value).cast("double").alias("v"))
    cell = met.join(held, ["i", "j"], "left").groupBy("dst").agg(
        F.first("wx").alias("wx"), F.first("wy").alias("wy"), *[F.max(F.when(F.col("c") == c, F.col("v"))).alias(f"v{c}") for c in range(4)]
    )
    east, north = F.col("wx"), F.col("wy")
    v = {(a, b): F.col(f"v{2 * b + a}") for a in (0, 1) for b in (0, 1)}

    def between(p: Column, q: Column, near: Column, side_x: Column, side_y: Column, middle: Column) -> Column:
        return p * q * near + (1 - p) * q * side_x + p * (1 - q) * side_y + (1 - p) * (1 - q) * middle

    whole = between(1 - east, 1 - north, v[0, 0], v[1, 0], v[0, 1], v[1, 1])
    known = [F.when(c.isNotNull(), 1).otherwise(0) for c in v.values()]
    n = sum(known[1:], known[0])
    one, other = (v[0, 0] + v[1, 1]) / 2, (v[1, 0] + v[0, 1]) / 2
    left = sum((F.coalesce(c, F.lit(0.0)) for c in list(v.values())[1:]), F.coalesce(v[0, 0], F.lit(0.0)))
    middle = F.when(n == 3, F.coalesce(one, other)).otherwise(left / n)
    out = F.lit(None).cast("double")
    lost = F.lit(False)
    for a, b in ((0, 1), (1, 1), (1, 0), (0, 0)):
        wa, wb = (east if a else 1 - east), (north if b else 1 - north)
        here, near = (wa >= 0.5) & (wb >= 0.5), v[a, b]
        side_x, side_y = ((near + F.coalesce(o, near)) / 2 for o in (v[1 - a, b], v[a, 1 - b]))
        # weights of the quadrant's own corner, doubled
        out = F.when(here, between(2 * wa - 1, 2 * wb - 1, near, side_x, side_y, middle)).otherwise(out)
        lost = lost | (here & near.isNull())
    return cell.select("dst", F.when(n == 4, whole).when((n > 0) & ~lost, out).alias("value"))


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Angle between two points, all in radians."""
    cosine = F.sin(lat1) * F.sin(lat2) + F.cos(lat1) * F.cos(lat2) * F.cos(lon1 - lon2)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def nearest_points(source: DataFrame, target: DataFrame, k: int, radius: float) -> DataFrame:
    """The ``k`` nearest sources ``(src, lon, lat)`` within ``radius`` of each ``(dst, lon, lat)``, in radians.

    Each target looks no further than it has to: radii shrink by the root of two down to where
    about ``k`` sources are expected, and the smallest counts whose small cell around the
    target (all within that radius) holds ``k`` sources; without one it is ``radius``. Points
    meet in cells of latitude and longitude as wide as the target's radius; toward a pole,
    and for a radius that reaches it, the longitude cells of a band shrink to one.
    Returns ``dst, src, distance, rank``; ties by source.
    """
    wanted = math.sqrt(4 * k / max(1, source.count()))
    radii = [radius]
    while radii[-1] > wanted and radii[-1] > 1e-6:
        radii.append(radii[-1] / math.sqrt(2))
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("level") + 1)
    levels = F.explode(F.sequence(F.lit(0), F.lit(len(radii) - 1)))
    turn = lambda lon: F.pmod(lon, F.lit(2 * math.pi)) / (2 * math.pi)
    # acos of a cosine near one is off by some 1e-16 over the distance
    bands = [max(1, int(math.pi / (r * 1.0001))) for r in radii]
    n, reach = pick(bands), pick([float(r) for r in radii])
    height = math.pi / n

    def cells_of(band: Column) -> Column:
        """Number of longitude cells of a band: cells are at least the radius wide there."""
        edge = F.greatest(F.abs(band * height - math.pi / 2), F.abs((band + 1) * height - math.pi / 2)) + reach
        wide = F.floor(2 * math.pi * F.cos(F.least(edge, F.lit(math.pi / 2))) / (reach * 1.2))
        return F.greatest(wide, F.lit(1))

    band = lambda lat: F.least(F.floor((lat + math.pi / 2) / height), n - 1)

    def small(df: DataFrame) -> DataFrame:
        """Cells whose points are within the level's radius of one another."""
        side = reach / 1.5
        row = F.floor((F.col("lat") + math.pi / 2) / side)
        edges = row * side - math.pi / 2, (row + 1) * side - math.pi / 2
        widest = F.when((edges[0] <= 0) & (edges[1] >= 0), 1.0).otherwise(F.cos(F.least(*[F.abs(e) for e in edges])))
        return df.withColumn("row", row).withColumn("column", F.floor(turn(F.col("lon")) * F.ceil(2 * math.pi * widest / side)))

    # levels above a radius of one are not searched for: small cells are flat only below
    fine = [k for k, r in enumerate(radii) if k and r <= 1]
    # small files make many pairs: dealt out by number, and nothing is taken for small and sent through the driver
    parts = int(target.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = target.select("dst", "lon", "lat").repartition(parts, "dst")
    if fine:
        each = F.explode(F.array(*[F.lit(k) for k in fine])).alias("level")
        full = small(source.select("lon", "lat", each)).groupBy("level", "row", "column").count().where(F.col("count") >= k)
        settled = small(t.select("*", each)).join(full.hint("merge"), ["level", "row", "column"]).groupBy("dst").agg(F.max("level").alias("level"))
        t = t.join(settled.hint("merge"), "dst", "left").withColumn("level", F.coalesce("level", F.lit(0)))
    else:
        t = t.withColumn("level", F.lit(0))
    s = source.withColumn("level", levels).withColumn("band", band(F.col("lat")))
    s = s.withColumn("cell", F.floor(turn(F.col("lon")) * cells_of(F.col("band"))))
    t = t.select("dst", "level", F.col("lon").alias("tlon"), F.col("lat").alias("tlat"), F.explode(F.sequence(band(F.col("lat")) - 1, band(F.col("lat")) + 1)).alias("band"))
    own = F.floor(turn(F.col("tlon")) * cells_of(F.col("band")))
    around = F.array_distinct(F.transform(F.array(*[F.lit(d) for d in (-1, 0, 1)]), lambda d: F.pmod(own + d, cells_of(F.col("band")))))
    t = t.where((F.col("band") >= 0) & (F.col("band") < n)).withColumn("cell", F.explode(around))
    place = ["level", "band", "cell"]
    pairs = t.repartition(parts, *place).join(s.repartition(parts, *place).hint("merge"), place)
    pairs = pairs.withColumn("distance", great_circle(F.col("lon"), F.col("lat"), F.col("tlon"), F.col("tlat"))).where(F.col("distance") <= reach)
    rank = F.row_number().over(Window.partitionBy("dst").orderBy("distance", "src"))
    return pairs.select("dst", "src", "distance", rank.alias("rank")).where(F.col("rank") <= k)


def inverse_distance(neighbours: DataFrame) -> DataFrame:
    """Weights 1 / distance, huge at no distance, not normalised (applying them normalises)."""
    return neighbours.withColumn("w", F.when(F.col("distance") <= 1e-10, 1e20).otherwise(1 / F.col("distance")))


def apply_inverse_distance(field: DataFrame, neighbours: DataFrame, value: str) -> DataFrame:
    """Inverse-distance means of valid neighbours, null where the nearest source is masked: ``dst, value``.

    ``neighbours`` are ``dst, src, distance, rank`` of ``nearest_points``; a source that
    ``field(src, value)`` lacks or holds as null is masked.
    """
    rows = inverse_distance(neighbours).join(field, "src", "left")
    w = F.when(F.col(value).isNotNull(), F.col("w"))
    out = rows.groupBy("dst").agg((F.sum(F.col(value) * w) / F.sum(w)).alias("value"), F.min_by(F.col(value).isNotNull(), "rank").alias("__near"))
    return out.select("dst", F.when(F.col("__near"), F.col("value")).alias("value"))


def clip(subject: np.ndarray, low: tuple[float, float], high: tuple[float, float]) -> np.ndarray:
    """A polygon (n, 2) cut to a box."""
    for axis, bound, sign in ((0, low[0], 1), (0, high[0], -1), (1, low[1], 1), (1, high[1], -1)):
        if not len(subject):
            break
        d = sign * (subject[:, axis] - bound)
        out = []
        for p, q, a, b in zip(subject, np.roll(subject, -1, 0), d, np.roll(d, -1)):
            if a >= 0:
                out.append(p)
            if (a >= 0) != (b >= 0):
                out.append(p + (q - p) * a / (a - b))
        subject = np.array(out).reshape(-1, 2)
    return subject


def polygon_area(points: np.ndarray) -> float:
    """Area on the unit sphere of a polygon (lon, lat in radians) with edges straight in both."""
    dx = np.roll(points[:, 0], -1) - points[:, 0]
    dx = (dx + np.pi) % (2 * np.pi) - np.pi
    a, b = points[:, 1], np.roll(points[:, 1], -1)
    dy = (a - b) / 2
    ratio = np.where(np.abs(dy) < 1e-10, 1.0, np.sin(dy) / np.where(np.abs(dy) < 1e-10, 1.0, dy))
    return float(-np.sum(dx * np.sin((a + b) / 2) * ratio))


def clip_overlaps(pairs: DataFrame, least: float = 1e-6) -> DataFrame:
    """Overlap areas of polygons with lat-lon boxes.

    ``pairs(src, dst, lon array, lat array, lon0, lat0, lon1, lat1)`` are candidates that
    a bounding-box join has found; a pair stays if its overlap is over ``least`` of the
    smaller area.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            areas = []
            for r in batch.itertuples():
                shape = np.stack([np.asarray(r.lon, float), np.asarray(r.lat, float)], 1)
                low, high = (r.lon0, r.lat0), (r.lon1, r.lat1)
                part = clip(shape, low, high)
                area = abs(polygon_area(part)) if len(part) > 2 else 0.0
                box = (r.lon1 - r.lon0) * (np.sin(r.lat1) - np.sin(r.lat0))
                areas.append(area if area > least * min(abs(polygon_area(shape)), box) else 0.0)
            out = batch[["src", "dst"]].assign(w=areas)
            yield out[out.w > 0]

    kinds = dict(pairs.dtypes)
    return pairs.mapInPandas(run, f"src {kinds['src']}, dst {kinds['dst']}, w double")


def bicubic_coefficients() -> np.ndarray:
    """The 16 x 16 matrix from values, x, y and xy slopes at four corners to coefficients.

    The surface is a sum of c[i, j] t^i u^j; its conditions at the corners are solved.
    """
    rows = []
    corners = [(0, 0), (1, 0), (1, 1), (0, 1)]
    for p, q in ((0, 0), (1, 0), (0, 1), (1, 1)):  # value, d/dt, d/du, both
        for t, u in corners:
            row = []
            for i in range(4):
                for j in range(4):
                    a = (t**i if p == 0 else (i * t ** (i - 1) if i else 0)) * (u**j if q == 0 else (j * u ** (j - 1) if j else 0))
                    row.append(float(a))
            rows.append(row)
    return np.linalg.inv(np.array(rows))


def bicubic(patches: DataFrame, keys: list[str]) -> DataFrame:
    """Bicubic value of each row of ``patches(keys, f array<double>(16), t, u)``.

    ``f`` holds the 4 x 4 neighbourhood row by row (y slowest); slopes are centred
    differences in index space. One Arrow batch at a time.
    """
    matrix = bicubic_coefficients()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            f = np.stack(batch["f"].to_numpy()).reshape(-1, 4, 4) if len(batch) else np.zeros((0, 4, 4))
            at = lambda a, i, j: a[:, j, i]
            corners = [(1, 1), (2, 1), (2, 2), (1, 2)]
            parts = [at(f, i, j) for i, j in corners]
            parts += [(at(f, i + 1, j) - at(f, i - 1, j)) / 2 for i, j in corners]
            parts += [(at(f, i, j + 1) - at(f, i, j - 1)) / 2 for i, j in corners]
            parts += [(at(f, i + 1, j + 1) - at(f, i - 1, j + 1) - at(f, i + 1, j - 1) + at(f, i - 1, j - 1)) / 4 for i, j in corners]
            c = (np.stack(parts, 1) @ matrix.T).reshape(-1, 4, 4)
            t, u = batch["t"].to_numpy(float), batch["u"].to_numpy(float)
            powers = np.arange(4)
            out = np.einsum("nij,ni,nj->n", c, t[:, None] ** powers, u[:, None] ** powers)
            yield batch[keys].assign(value=out)

    kinds = dict(patches.dtypes)
    return patches.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", value double")


def _cubic_axis(axis: list[float], value: Column, upto: Column, cyclic: float | None, at_k: str, at_t: str) -> tuple[Column, Column, Column]:
    """The interval ``at_k`` of a place, its part ``at_t`` and, from both, the four points (from 0) around with weights.

    Hermite's cubic between the two, with slopes by differences of the points beside each
    over what lies between them; at the ends of the axis, of the point itself and its one
    neighbour. What only depends on the interval is worked out here, an array an item. Of
    two of the four that are one point, the later has both weights and the other is null.
    """
    n = len(axis)
    if n < 2:
        raise ValueError("an axis has two points or more")
    around = []
    for k in range(n if cyclic is not None else n - 1):
        if cyclic is not None:
            places, at = [(k + d) % n for d in (-1, 0, 1, 2)], [axis[(k + d) % n] + cyclic * ((k + d) // n) for d in (-1, 0, 1, 2)]
        else:
            places = [max(k - 1, 0), k, k + 1, min(k + 2, n - 1)]
            at = [axis[x] for x in places]
        step = at[2] - at[1]
        around.append((*places, step / (at[2] - at[0]), step / (at[3] - at[1]), at[1], step))
    lists = [constants(list(x)) for x in zip(*around)]
    if cyclic is not None:
        interval = F.when(upto < 1, n).otherwise(upto)
    else:
        interval = F.least(F.greatest(upto, F.lit(1)), F.lit(n - 1))
    item = lambda k: F.element_at(lists[k], F.col(at_k))
    past = F.pmod(value - item(6), F.lit(cyclic)) if cyclic is not None else value - item(6)
    t = F.col(at_t)
    h00, h10, h01, h11 = (1 + 2 * t) * (1 - t) * (1 - t), t * (1 - t) * (1 - t), t * t * (3 - 2 * t), t * t * (t - 1)
    weights = [-h10 * item(4), h00 - h11 * item(5), h01 + h10 * item(4), h11 * item(5)]
    rows = [F.struct(item(k).cast("long").alias("k"), w.alias("w")) for k, w in enumerate(weights)]
    for a, b in ((a, b) for a in range(4) for b in range(a + 1, 4) if any(x[a] == x[b] for x in around)):
        one = item(a) == item(b)  # each point is in one such pair at most
        rows[b] = F.struct(item(b).cast("long").alias("k"), F.when(one, weights[a] + weights[b]).otherwise(weights[b]).alias("w"))
        rows[a] = F.when(~one, rows[a])
    parts = F.array(*rows)
    return interval, F.least(F.greatest(past / item(7), F.lit(0.0)), F.lit(1.0)), parts


def bicubic_weights(points: DataFrame, x_axis: list[float], y_axis: list[float], x: str = "x", y: str = "y", target: str = "dst", cyclic: float | None = None) -> DataFrame:
    """Rows ``(dst, i, j, w)`` (points from 0) of a bicubic surface over a rectilinear grid of any steps.

    The surface has the field's values at the grid's points and slopes by differences of
    their neighbours, both along the axes and across; it is a product of two cubics, so its
    weights on the sixteen points around are products too and sum to one. Beyond the axes
    the nearest edge is followed; ``cyclic`` closes the x axis. A target has one row a
    point, made from the target's row alone. Apply them with ``apply_weights``.
    """
    df, parts = points.select(target, F.col(x).alias("__x"), F.col(y).alias("__y")), []
    for axis, period, c in ((x_axis, cyclic, "__x"), (y_axis, None, "__y")):
        interval, t, part = _cubic_axis(axis, F.col(c), F.col("__u"), period, f"{c}k", f"{c}t")
        df = df.withColumn("__u", points_upto(axis, F.col(c))).withColumn(f"{c}k", interval).withColumn(f"{c}t", t).drop("__u")
        parts.append(part)
    df = df.select(target, "__yk", "__yt", F.explode(parts[0]).alias("a")).where("a is not null")
    df = df.select(target, "a", F.explode(parts[1]).alias("b")).where("b is not null")
    return df.select(target, F.col("a.k").alias("i"), F.col("b.k").alias("j"), (F.col("a.w") * F.col("b.w")).alias("w"))


def containing_cells(points: DataFrame, quads: DataFrame, width: float) -> DataFrame:
    """``(dst, cell)``: the cell of a curvilinear grid that holds each point, the least if on an edge.

    ``points(dst, x, y)``; ``quads(cell, x1, y1, .. x4, y4)`` are convex, corners in
    order around. Both meet in square bins of ``width`` that a quad's box touches, so
    the join is an equi-join; choose ``width`` near a cell's size. A point is inside if
    it is on no side's other hand, whichever way the corners turn. Points in no cell
    are left out.
    """
    xs, ys = [f"x{i}" for i in range(1, 5)], [f"y{i}" for i in range(1, 5)]
    cut = lambda c: F.floor(c / width)
    boxes = quads.withColumn("bx", F.explode(F.sequence(cut(F.least(*xs)), cut(F.greatest(*xs)))))
    boxes = boxes.withColumn("by", F.explode(F.sequence(cut(F.least(*ys)), cut(F.greatest(*ys)))))
    placed = points.withColumn("bx", cut(F.col("x"))).withColumn("by", cut(F.col("y")))
    turns = []
    for i in range(4):
        ax, ay, bx, by = F.col(xs[i]), F.col(ys[i]), F.col(xs[(i + 1) % 4]), F.col(ys[(i + 1) % 4])
        turns.append((bx - ax) * (F.col("y") - ay) - (by - ay) * (F.col("x") - ax))
    inside = (F.least(*turns) >= 0) | (F.greatest(*turns) <= 0)
    return placed.join(boxes, ["bx", "by"]).where(inside).groupBy("dst").agg(F.min("cell").alias("cell"))
