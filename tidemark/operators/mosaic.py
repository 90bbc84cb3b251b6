"""Tiles that touch: contacts found from corner coordinates, and gradients across them.

``corners(tile, i, j, lon, lat)`` are the grid points of each tile, from 0 along both axes,
in radians. Points of different tiles (or of one tile's own ends) are the same place if
their unit vectors lie within ``NEAR``; only points on tiles' edges are compared, in bins
of that size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.geometry import vector
from tidemark.operators.polygons import padded, signed_area

NEAR = 1e-7


def _edge_points(corners: DataFrame) -> DataFrame:
    """Points on edges, once an edge: ``tile, edge, along, i, j, p``."""
    ends = corners.groupBy("tile").agg(F.max("i").alias("ni"), F.max("j").alias("nj"))
    on = lambda edge, off, along: F.struct(F.lit(edge).alias("edge"), off.alias("off"), along.alias("along"))
    i, j = F.col("i"), F.col("j")
    places = F.array(on("W", i, j), on("E", F.col("ni") - i, j), on("S", j, i), on("N", F.col("nj") - j, i))
    points = corners.join(ends, "tile").withColumn("at", F.explode(F.filter(places, lambda x: x["off"] == 0)))
    return points.select("tile", "at.edge", F.col("at.along").alias("along"), "i", "j", vector(F.col("lon"), F.col("lat")).alias("p"))


def _bin(p: Column, steps: tuple[int, int, int] | None = None) -> Column:
    """The bin of a place: half of what is near lies in the bin, the rest in those around it."""
    return F.struct(*[(F.floor(p[c] / (2 * NEAR)) + (steps[k] if steps else 0)).alias(c) for k, c in enumerate("xyz")])


def _around(p: Column) -> Column:
    return F.array(*[_bin(p, (a, b, c)) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)])


def _apart(p: Column, q: Column) -> Column:
    return F.greatest(*[F.abs(p[c] - q[c]) for c in "xyz"])


def find_contacts(corners: DataFrame) -> DataFrame:
    """``tile, edge, first, last, to_tile, to_edge, to_first, to_last, reverse``: each contact, from both sides.

    A contact is a stretch of cells, numbered along the edge, whose sides are those of
    cells of another edge (or of the same edge, folded). ``reverse`` says that the numbers
    run against each other; ``to_first`` is then the place that touches ``last``. Sides
    without length (at a pole) touch nothing.
    """
    points = _edge_points(corners)
    after = points.select("tile", "edge", (F.col("along") - 1).alias("along"), F.col("p").alias("q"))
    sides = points.join(after, ["tile", "edge", "along"]).where(_apart(F.col("p"), F.col("q")) > NEAR)
    sides = sides.select("tile", "edge", "along", "p", "q", F.struct(*[((F.col("p")[c] + F.col("q")[c]) / 2).alias(c) for c in "xyz"]).alias("m"))
    here = sides.select("tile", "edge", "along", "p", "q", "m", F.explode(_around(F.col("m"))).alias("bin"))
    there = sides.select(*[F.col(c).alias(f"to_{c}") for c in ("tile", "edge", "along", "p", "q", "m")], _bin(F.col("m")).alias("bin"))
    met = here.join(there, "bin").where(_apart(F.col("m"), F.col("to_m")) <= NEAR)
    met = met.where("tile <> to_tile or edge <> to_edge or along <> to_along")
    straight = (_apart(F.col("p"), F.col("to_p")) <= NEAR) & (_apart(F.col("q"), F.col("to_q")) <= NEAR)
    turned = (_apart(F.col("p"), F.col("to_q")) <= NEAR) & (_apart(F.col("q"), F.col("to_p")) <= NEAR)
    met = met.where(straight | turned).withColumn("reverse", ~straight)
    shift = F.when(F.col("reverse"), F.col("to_along") + F.col("along")).otherwise(F.col("to_along") - F.col("along"))
    keys = ["tile", "edge", "to_tile", "to_edge", "reverse"]
    span = [f(c).alias(n) for c, names in (("along", ("first", "last")), ("to_along", ("to_first", "to_last"))) for f, n in zip((F.min, F.max), names)]
    found = met.groupBy(*keys, shift.alias("shift")).agg(*span)
    return found.select("tile", "edge", "first", "last", "to_tile", "to_edge", "to_first", "to_last", "reverse")


def same_points(corners: DataFrame) -> DataFrame:
    """``tile, i, j, node``: each grid point with the place it lies at, the least ``(tile, i, j)`` there."""
    own = F.struct("tile", "i", "j")
    edge = _edge_points(corners).select("tile", "i", "j", "p").dropDuplicates(["tile", "i", "j"])
    here = edge.select("tile", "i", "j", "p", F.explode(_around(F.col("p"))).alias("bin"))
    there = edge.select(own.alias("node"), F.col("p").alias("q"), _bin(F.col("p")).alias("bin"))
    least = here.join(there, "bin").where(_apart(F.col("p"), F.col("q")) <= NEAR).groupBy("tile", "i", "j").agg(F.min("node").alias("shared"))
    out = corners.select("tile", "i", "j").join(least, ["tile", "i", "j"], "left")
    return out.select("tile", "i", "j", F.coalesce("shared", own).alias("node"))


def _lists(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [padded(batch.column(n)) for n in names]


def _centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells with the unit vectors of their centres."""
    for batch in batches:
        if batch.num_rows:
            centre = np.stack(_lists(batch, "x", "y", "z"), -1).sum(1)
            centre /= np.linalg.norm(centre, axis=-1, keepdims=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c) for c in centre.T]], names=[*batch.schema.names, "cx", "cy", "cz"])


def _angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arctan2(np.linalg.norm(np.cross(a, b), axis=-1), (a * b).sum(-1))


def corner_values(tiles: np.ndarray, counts: np.ndarray, values: np.ndarray, centres: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The field at grid points (n) from their cells (n, 4), sorted by tile; of fewer cells the last is repeated.

    The mean of the cells, three at a cube's corner. Where two cells of each of two tiles
    meet, both pairs across the edge have a mean half-way between their centres, and the
    point, which lies on the edge between these, takes them by inverse distance.
    """
    held = np.arange(values.shape[1]) < counts[:, None]
    out = np.where(held, values, 0.0).sum(1) / counts
    edge = np.flatnonzero(counts == 4) if values.shape[1] == 4 else np.zeros(0, int)
    t = tiles[edge]
    edge = edge[(t[:, 0] == t[:, 1]) & (t[:, 2] == t[:, 3]) & (t[:, 0] != t[:, 3])] if len(edge) else edge
    if len(edge):
        c, v, p = centres[edge], values[edge], places[edge]
        near = lambda a, b: (c[:, a] * c[:, b]).sum(-1)
        # of the two ways to pair the tiles' cells, the one with the nearer pairs
        straight = near(0, 2) + near(1, 3) >= near(0, 3) + near(1, 2)
        mate = np.where(straight[:, None], [[2, 3]], [[3, 2]])
        rows = np.arange(len(edge))
        away, mean = [], []
        for k in (0, 1):
            middle = c[:, k] + c[rows, mate[:, k]]
            away.append(_angle(middle, p))
            mean.append((v[:, k] + v[rows, mate[:, k]]) / 2)
        out[edge] = (mean[0] * away[1] + mean[1] * away[0]) / (away[0] + away[1])
    return out


def _at_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            tiles, values, x, y, z = _lists(batch, "tiles", "values", "cx", "cy", "cz")
            counts = np.diff(batch.column("tiles").offsets.to_numpy())
            place = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "z")], -1)
            found = corner_values(tiles, counts, values, np.stack([x, y, z], -1), place)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found)], names=["node", "at_node"])


def _slopes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Green's theorem round each cell: normals, lengths and mean values of its sides, over its area."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y, z, v = _lists(batch, "x", "y", "z", "v")
        p = np.stack([x, y, z], -1)
        q = np.roll(p, -1, 1)
        normal = -np.cross(p, q)
        length = np.linalg.norm(normal, axis=-1)
        part = (v + np.roll(v, -1, 1)) / 2 * _angle(p, q) / np.where(length > 0, length, 1.0)
        g = (normal * part[..., None]).sum(1) / signed_area(p)[:, None]
        m = p.sum(1)
        m /= np.linalg.norm(m, axis=-1, keepdims=True)
        flat = np.hypot(m[:, 0], m[:, 1])
        pole = flat < 1e-9  # no east there
        flat = np.where(pole, 1.0, flat)
        east = (-m[:, 1] * g[:, 0] + m[:, 0] * g[:, 1]) / flat
        north = -m[:, 2] * (m[:, 0] * g[:, 0] + m[:, 1] * g[:, 1]) / flat + flat * g[:, 2]
        slopes = [pa.array(s, mask=pole) for s in (east, north)]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("tile", "i", "j")], *slopes], names=["tile", "i", "j", "east", "north"])


def tile_gradient(field: DataFrame, corners: DataFrame, value: str) -> DataFrame:
    """``tile, i, j, east, north``: the gradient on the unit sphere of ``field(tile, i, j, value)``, cells from 0.

    The field is brought to the grid points, across contacts too, and from there round
    each cell, in the directions of east and north at its centre (null at a pole). A
    missing or null cell counts for no point and has no gradient. Arrow batches hold the
    four points of a cell and the four cells of a point; cells meet points by joins.
    """
    names = ["tile", "i", "j"]
    p = vector(F.col("lon"), F.col("lat"))
    place = corners.select(*names, p.alias("p")).join(same_points(corners), names).select(*names, "p.*", "node")
    steps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))])
    held = field.where(F.col(value).isNotNull()).select(*[F.col(c).cast("long").alias(f"c{c}") for c in names], F.col(value).cast("double").alias("value"), F.explode(steps).alias("s"))
    held = held.select(*[f"c{c}" for c in names], "value", "s.k", F.col("ctile").alias("tile"), (F.col("ci") + F.col("s.a")).alias("i"), (F.col("cj") + F.col("s.b")).alias("j"))
    held = held.join(place, names).drop(*names)
    cell = [f"c{c}" for c in names]
    rows = F.sort_array(F.collect_list(F.struct("k", "x", "y", "z", "node")))
    ring = held.groupBy(*cell).agg(F.max("value").alias("value"), rows.alias("r")).where(F.size("r") == 4)
    ring = ring.select(*cell, "value", "r.x", "r.y", "r.z", "r.node")
    kinds = dict(ring.dtypes)
    ring = ring.mapInArrow(_centres, ", ".join(f"{c} {kinds[c]}" for c in ring.columns) + ", cx double, cy double, cz double")
    points = F.arrays_zip(F.sequence(F.lit(0), F.lit(3)).alias("k"), *[F.col(c).alias(c) for c in ("x", "y", "z", "node")])
    around = ring.select(*cell, "value", "cx", "cy", "cz", F.explode(points).alias("r")).select(*cell, "value", "cx", "cy", "cz", "r.*")
    rows = F.sort_array(F.collect_list(F.struct(*cell, "value", "cx", "cy", "cz")))
    at = around.groupBy("node").agg(rows.alias("r"), *[F.min(c).alias(c) for c in ("x", "y", "z")])
    at = at.select("node", "x", "y", "z", F.col("r.ctile").alias("tiles"), F.col("r.value").alias("values"), "r.cx", "r.cy", "r.cz")
    at = at.mapInArrow(_at_nodes, f"node {kinds['node'][len('array<'):-1]}, at_node double")
    rows = F.sort_array(F.collect_list(F.struct("k", "x", "y", "z", "at_node")))
    full = around.join(at, "node").groupBy(*cell).agg(rows.alias("r"))
    full = full.select(*[F.col(f"c{c}").alias(c) for c in names], "r.x", "r.y", "r.z", F.col("r.at_node").alias("v"))
    return full.mapInArrow(_slopes, "tile long, i long, j long, east double, north double")
