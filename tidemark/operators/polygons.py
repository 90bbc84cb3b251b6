"""Overlaps of polygons with polygons on the sphere: areas and centroids of what two grids share.

Cells are rows ``(name, lon, lat)`` with arrays of corners in radians, in order around;
a grid's neighbours share corners. Edges are great circles, or straight in longitude and
latitude. Cells meet in bins that their boxes touch (an equi-join), boxes that do not
overlap go, and whole Arrow batches of candidates are clipped at once, a clip edge at a
time for all pairs of the batch. Targets are convex; sources may be any simple polygon.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A shared area counts if it is over this part of the smaller cell, unless a call says otherwise.
LEAST = 1e-6
#: Nodes and weights of five-point Gauss quadrature over [0, 1].
_NODES, _WEIGHTS = (x for x in np.polynomial.legendre.leggauss(5))
_NODES, _WEIGHTS = (_NODES + 1) / 2, _WEIGHTS / 2


def padded(column: pa.ListArray) -> np.ndarray:
    """Lists as rows of one width, the last point repeated: edges of no length change nothing."""
    offsets = column.offsets.to_numpy()
    counts = np.diff(offsets)
    if not len(counts):
        return np.zeros((0, 1))
    at = offsets[:-1, None] - offsets[0] + np.minimum(np.arange(max(1, counts.max())), counts[:, None] - 1)
    return column.flatten().to_numpy(zero_copy_only=False)[at]


def unit(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], -1)


def _side(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """On which side of each pair's edge from ``a`` to ``b`` its points lie: positive on the left."""
    if points.shape[-1] == 3:
        return np.einsum("nmd,nd->nm", points, np.cross(a, b))
    along, to = (b - a)[:, None], points - a[:, None]
    return along[..., 0] * to[..., 1] - along[..., 1] * to[..., 0]


def signed_area(shape: np.ndarray) -> np.ndarray:
    """Areas (n) of polygons (n, m, 3) with great-circle edges or (n, m, 2) straight in lon and lat; positive anticlockwise."""
    after = np.roll(shape, -1, 1)
    if shape.shape[-1] == 3:
        first = shape[:, :1]
        triple = np.einsum("nmd,nmd->nm", np.broadcast_to(first, shape.shape), np.cross(shape, after))
        around = 1 + (first * shape).sum(-1) + (shape * after).sum(-1) + (after * first).sum(-1)
        return 2 * np.arctan2(triple, around).sum(1)
    half = (after[..., 1] - shape[..., 1]) / 2
    return -((after[..., 0] - shape[..., 0]) * np.sin((after[..., 1] + shape[..., 1]) / 2) * np.sinc(half / np.pi)).sum(1)


def centroid(shape: np.ndarray) -> np.ndarray:
    """Longitudes and latitudes (n, 2) of the centres of area."""
    after = np.roll(shape, -1, 1)
    if shape.shape[-1] == 3:
        normal = np.cross(shape, after)
        sine = np.linalg.norm(normal, axis=-1)
        angle = np.arctan2(sine, (shape * after).sum(-1))
        moment = (normal * (angle / np.where(sine > 0, sine, 1.0))[..., None]).sum(1)
        moment *= np.sign(signed_area(shape))[:, None]
        return np.stack([np.arctan2(moment[:, 1], moment[:, 0]), np.arctan2(moment[:, 2], np.hypot(moment[:, 0], moment[:, 1]))], 1)
    lon = shape[..., :1] + (after - shape)[..., :1] * _NODES
    lat = shape[..., 1:] + (after - shape)[..., 1:] * _NODES
    step = (after - shape)[..., :1] * _WEIGHTS
    area = signed_area(shape)
    area = np.where(area == 0, 1.0, area)
    east = -(lon * np.sin(lat) * step).sum((1, 2))
    north = -((np.cos(lat) + lat * np.sin(lat)) * step).sum((1, 2))
    return np.stack([east / area, north / area], 1)


def clip_all(subject: np.ndarray, clipper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Polygons (n, m, d) cut to convex ones (n, k, d), and which of them are left."""
    turn = np.where(signed_area(clipper) >= 0, 1.0, -1.0)[:, None]
    left = np.ones(len(subject), bool)
    ends = np.roll(clipper, -1, 1)
    for k in range(clipper.shape[1]):
        d = turn * _side(subject, clipper[:, k], ends[:, k])
        d = np.where(np.abs(d) < 1e-15, 0.0, d)
        later, ahead = np.roll(subject, -1, 1), np.roll(d, -1, 1)
        inside = d >= 0
        crosses = inside != (ahead >= 0)
        gap = np.where(crosses, d - ahead, 1.0)
        cut = subject + (later - subject) * (d / gap)[..., None]
        if subject.shape[-1] == 3:
            cut /= np.maximum(np.linalg.norm(cut, axis=-1, keepdims=True), 1e-300)
        points = np.stack([subject, cut], 2).reshape(len(subject), -1, subject.shape[-1])
        kept = np.stack([inside, crosses], 2).reshape(len(subject), -1)
        counts = kept.sum(1)
        left &= counts > 0
        order = np.argsort(~kept, 1, kind="stable")[:, : max(1, int(counts.max(initial=1)))]
        order = np.take_along_axis(order, np.minimum(np.arange(order.shape[1]), np.maximum(counts, 1)[:, None] - 1), 1)
        subject = np.take_along_axis(points, order[..., None], 1)
    return subject, left


def _shared(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Areas (n) and centres (n, 2) of what pairs share: 0 where that is not over ``least`` of the smaller cell."""
    part, left = clip_all(a, b)
    area = np.where(left, np.abs(signed_area(part)), 0.0)
    keep = area > least * np.minimum(np.abs(signed_area(a)), np.abs(signed_area(b)))
    centre = np.zeros((len(area), 2))
    if keep.any():
        centre[keep] = centroid(part[keep])
    return np.where(keep, area, 0.0), centre


def _overlap(batches: Iterator[pa.RecordBatch], sphere: bool, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        lon0, lat0, lon1, lat1 = (padded(batch.column(c)) for c in ("s_lon", "s_lat", "d_lon", "d_lat"))
        make = unit if sphere else (lambda x, y: np.stack([x, y], -1))
        a, b = make(lon0, lat0), make(lon1, lat1)
        area, centre = _shared(a, b, least)
        turn = 2 * math.pi
        # wide cells may meet again a turn further: both sides of a cut of the circle are one pair
        while not sphere and len(at := np.flatnonzero(lon1.max(1) >= lon0.min(1) + turn)):
            more, middle = _shared(make(lon0[at] + turn, lat0[at]), b[at], least)
            both = area[at] + more
            centre[at] = (area[at, None] * centre[at] + more[:, None] * middle) / np.where(both > 0, both, 1.0)[:, None]
            area[at] = both
            turn += 2 * math.pi
        keep = np.flatnonzero(area)
        at = pa.array(keep)
        yield pa.RecordBatch.from_arrays(
            [batch.column("src").take(at), batch.column("dst").take(at), pa.array(area[keep]), pa.array(centre[keep, 0]), pa.array(centre[keep, 1])], names=["src", "dst", "w", "lon", "lat"]
        )


def _flat_boxes(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """Corners within half a turn of the first, moved by whole turns so that boxes begin in [0, 2 pi), and the boxes."""
    whole = 2 * math.pi
    for batch in batches:
        lon, lat = padded(batch.column("lon")), padded(batch.column("lat"))
        there = np.flatnonzero(~np.isnan(lon + lat).any(1))  # a corner without a place leaves no area
        lon, lat = lon[there], lat[there]
        lon = lon[:, :1] + np.mod(lon - lon[:, :1] + math.pi, whole) - math.pi
        lon -= np.floor(lon.min(1) / whole)[:, None] * whole
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1, dtype=np.int32) * c.shape[1]), pa.array(c.ravel())) for c in (lon, lat)]
        box = [pa.array(f(c, 1)) for f in (np.min, np.max) for c in (lon, lat)]
        yield pa.RecordBatch.from_arrays([batch.column(name).take(pa.array(there)), *lists, *box], names=[name, "lon", "lat", "x0", "y0", "x1", "y1"])


def _boxed(cells: DataFrame, name: str, sphere: bool) -> DataFrame:
    """Cells with the corners ``lo`` and ``hi`` of their boxes: longitude from [0, 2 pi) on, and latitude or (``sphere``) its sine."""
    whole = 2 * math.pi
    if not sphere:
        kind = dict(cells.dtypes)[name]
        df = cells.select(name, "lon", "lat").where((F.size("lon") >= 3) & (F.size("lat") > 0))
        df = df.mapInArrow(lambda b: _flat_boxes(b, name), f"{name} {kind}, lon array<double>, lat array<double>, x0 double, y0 double, x1 double, y1 double")
        return df.select(name, "lon", "lat", F.array("x0", "y0").alias("lo"), F.array("x1", "y1").alias("hi"))
    at = F.arrays_zip(F.col("lon").alias("lon"), F.col("lat").alias("lat"))
    df = cells.select(F.col(name), "lon", "lat").where(F.size("lon") >= 3)
    xyz = [
        F.transform(at, lambda p: F.cos(p["lat"]) * F.cos(p["lon"])), F.transform(at, lambda p: F.cos(p["lat"]) * F.sin(p["lon"])),
        F.transform("lat", F.sin),
    ]
    df = df.select("*", *[v.alias(f"v{k}") for k, v in enumerate(xyz)])
    total = [F.aggregate(f"v{k}", F.lit(0.0), lambda s, x: s + x) for k in range(3)]
    df = df.select("*", *[t.alias(f"t{k}") for k, t in enumerate(total)])
    length = F.sqrt(F.col("t0") * F.col("t0") + F.col("t1") * F.col("t1") + F.col("t2") * F.col("t2"))
    corners = F.arrays_zip(*[F.col(f"v{k}").alias(f"v{k}") for k in range(3)])
    near = F.array_min(F.transform(corners, lambda p: (p["v0"] * F.col("t0") + p["v1"] * F.col("t1") + p["v2"] * F.col("t2")) / length))
    bulge = 1 / near - 1 + 1e-12  # how far the sphere is beyond the flat hull of the corners
    # edges keep to the longitudes of their ends while a cell spans less than half a turn; a pole has none of its own
    away = F.filter(at, lambda p: F.abs(p["lat"]) < math.pi / 2 - 1e-9)
    df = df.select(name, "lon", "lat", (F.array_min("v2") - bulge).alias("z0"), (F.array_max("v2") + bulge).alias("z1"), F.transform(away, lambda p: p["lon"]).alias("away"))
    first = F.element_at("away", 1)
    turned = F.transform("away", lambda x: F.pmod(x - first + math.pi, F.lit(whole)) - math.pi)
    df = df.select("*", first.alias("first"), F.array_min(turned).alias("west"), F.array_max(turned).alias("east"))
    narrow = F.col("east") - F.col("west") < math.pi - 1e-6
    begin = F.when(narrow, F.pmod(F.col("first") + F.col("west") - 1e-12, F.lit(whole))).otherwise(0.0)
    df = df.select("*", begin.alias("x0"), F.when(narrow, F.col("east") - F.col("west") + 2e-12).otherwise(whole).alias("span"))
    return df.select(name, "lon", "lat", F.array("x0", "z0").alias("lo"), F.array(F.col("x0") + F.col("span"), F.col("z1")).alias("hi"))


def _bins(boxes: list[DataFrame], width: float) -> list[float]:
    """Widths of bins in both directions: of the side with the larger boxes their mean, ``width`` at most.

    So boxes lie in a few bins each on average, however narrow cells are in one direction.
    """
    extent = [F.avg(F.element_at("hi", k) - F.element_at("lo", k)) for k in (1, 2)]
    means = functools.reduce(DataFrame.unionAll, [b.agg(*extent) for b in boxes]).collect()
    return [min(width, max(1e-9, *(m[k] for m in means))) if all(m[k] is not None for m in means) else width for k in range(2)]


def cell_overlaps(source: DataFrame, target: DataFrame, width: float, edges: str = "great_circle", least: float = LEAST) -> DataFrame:
    """``(src, dst, w, lon, lat)``: shared areas on the unit sphere and their centres.

    ``source(src, lon, lat)`` and ``target(dst, lon, lat)``; ``edges`` are ``great_circle`` or
    ``lon_lat``. Bins of longitude and latitude (of its sine for great circles) are as wide
    as the boxes on average, and at most ``width``. Great-circle cells lie within less than
    a quarter of the sphere; lon-lat cells wrap around but hold no pole inside (a pole may
    be a corner). Slivers up to ``least`` of the smaller cell are no rows: where sums must
    add up to the cells, make it less.
    """
    if edges not in ("great_circle", "lon_lat"):
        raise ValueError("edges are great_circle or lon_lat")
    sphere = edges == "great_circle"
    # boxes are worked out by all tasks, however few files cells come from
    s, t = _boxed(source.repartition("src"), "src", sphere), _boxed(target.repartition("dst"), "dst", sphere)
    widths = _bins([s, t], width)
    turn = lambda n: (F.col("turn") + n) * F.lit(2 * math.pi)
    east = lambda a: F.array(F.element_at(a, 1) + turn(0), F.element_at(a, 2))
    moved = F.col("lon") if sphere else F.transform("lon", lambda x: x + turn(0))
    s = s.withColumn("turn", F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)])))
    s = s.select("src", moved.alias("lon"), "lat", east("lo").alias("lo"), east("hi").alias("hi"), (F.element_at("hi", 1) + turn(-1)).alias("before"), "turn")

    def binned(df: DataFrame, prefix: str, name: str, *more: str) -> DataFrame:
        df = df.select(name, *more, *[F.col(c).alias(f"{prefix}_{c}") for c in ("lon", "lat", "lo", "hi")])
        for k, w in enumerate(widths):
            edge = lambda c, k=k, w=w: F.floor(F.element_at(f"{prefix}_{c}", k + 1) / w)
            df = df.withColumn(f"b{k}", F.explode(F.sequence(edge("lo"), edge("hi"))))
        return df

    # moved boxes that no target can touch are no rows
    reach = (F.element_at("hi", 1) >= 0) & (F.element_at("lo", 1) <= 4 * math.pi)
    pairs = binned(s.where(reach), "s", "src", "before", "turn").join(binned(t, "d", "dst").hint("merge"), ["b0", "b1"])
    met: Column = F.lit(True)
    for k, w in enumerate(widths):
        low = F.greatest(F.element_at("s_lo", k + 1), F.element_at("d_lo", k + 1))
        high = F.least(F.element_at("s_hi", k + 1), F.element_at("d_hi", k + 1))
        met = met & (low <= high) & (F.floor(low / w) == F.col(f"b{k}"))  # a pair counts in one bin
    # and in the first turn in which its boxes meet
    met = met & ((F.col("turn") == -1) | (F.col("before") < F.element_at("d_lo", 1)))
    pairs = pairs.where(met).select("src", "dst", "s_lon", "s_lat", "d_lon", "d_lat")
    kinds = dict(pairs.dtypes)
    return pairs.mapInArrow(lambda b: _overlap(b, sphere, least), f"src {kinds['src']}, dst {kinds['dst']}, w double, lon double, lat double")


def cell_areas(cells: DataFrame, name: str, edges: str = "great_circle") -> DataFrame:
    """``(name, area, lon, lat)``: areas on the unit sphere and centres of polygons."""
    sphere = edges == "great_circle"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lon, lat = padded(batch.column("lon")), padded(batch.column("lat"))
            shape = unit(lon, lat) if sphere else np.stack([lon, lat], -1)
            centre = centroid(shape)
            yield pa.RecordBatch.from_arrays([batch.column(name), pa.array(np.abs(signed_area(shape))), pa.array(centre[:, 0]), pa.array(centre[:, 1])], names=[name, "area", "lon", "lat"])

    first = F.element_at("lon", 1)
    lon = F.transform("lon", lambda x: first + F.pmod(x - first + math.pi, F.lit(2 * math.pi)) - math.pi)
    kind = dict(cells.dtypes)[name]
    return cells.select(name, lon.alias("lon"), "lat").mapInArrow(run, f"{name} {kind}, area double, lon double, lat double")
