"""Halo cells: copies of the cells at an edge, beyond the end of the grid or in the tile next to it.

Only cells near an edge are copied, by filters and a table of contacts (a few rows a
tile), so nothing of the interior is joined or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EDGES = ("W", "E", "S", "N")
CONTACTS = "tile long, edge string, to_tile long, to_edge string, reverse boolean"


def with_halo(
    df: DataFrame, i: str, j: str, shape: tuple[int, int], width: int, cyclic: tuple[bool, bool] = (False, False),
    fold: bool = False, turned: tuple[str, ...] = (), position: str = "centre",
) -> DataFrame:
    """``df`` (cells from 0) and its halo of ``width`` cells beyond cyclic ends and the fold.

    With ``fold`` the northern edge is folded onto itself in the middle: beyond it lie the
    same rows, turned by 180 degrees, and the columns ``turned`` (components of vectors)
    change sign. ``position`` is where in its cell a value lies: centre, east, north or
    corner; values on the fold itself stay as they are. Corners are filled where both
    axes have a halo. Null values are copied; a halo wider than the grid is an error.
    """
    nx, ny = shape
    if position not in ("centre", "east", "north", "corner"):
        raise ValueError(f"unknown position {position!r}")
    if fold and (cyclic[1] or not cyclic[0]):
        raise ValueError("a folded grid is cyclic from west to east and not from south to north")
    east, north = int(position in ("east", "corner")), int(position in ("north", "corner"))
    if width > min(nx, ny - north):
        raise ValueError("the halo is wider than the grid")
    out = df
    if fold:
        x, y = F.pmod(F.lit(nx - 1 - east) - F.col(i), F.lit(nx)), F.lit(2 * ny - 1 - north) - F.col(j)
        image = df.where(y.between(ny, ny + width - 1))
        out = out.unionByName(image.withColumns({i: x, j: y} | {c: -F.col(c) for c in turned}))
    for axis, n, on in ((i, nx, cyclic[0]), (j, ny, cyclic[1])):
        if on:
            low, high = out.where(F.col(axis) < width), out.where(F.col(axis) >= n - width)
            out = out.unionByName(low.withColumn(axis, F.col(axis) + n)).unionByName(high.withColumn(axis, F.col(axis) - n))
    return out


def cube_contacts(spark: SparkSession) -> DataFrame:
    """The contacts of a cube's six tiles (from 1), both ways round.

    An odd tile's east meets the next tile's west and its north the west of the one
    after that, reversed; an even tile's north meets the next tile's south and its east
    the south of the one after that, reversed.
    """
    one_way = []
    for t in range(1, 7):
        after, second = t % 6 + 1, (t + 1) % 6 + 1
        straight, bent, entry = ("E", "N", "W") if t % 2 else ("N", "E", "S")
        one_way += [(t, straight, after, entry, False), (t, bent, second, entry, True)]
    back = [(b, e2, a, e1, r) for a, e1, b, e2, r in one_way]
    return spark.createDataFrame(one_way + back, CONTACTS)


def _on_edges(i: Column, j: Column, last_i: int, last_j: int, vector: tuple[Column, Column]) -> Column:
    """A struct an edge: its distance, the place along it and the vector out of and along it."""
    u, v = vector
    rows = (("W", i, j, -u, v), ("E", last_i - i, j, u, v), ("S", j, i, -v, u), ("N", last_j - j, i, v, u))
    names = ("edge", "depth", "along", "out", "side")
    return F.array(*[F.struct(*[(F.lit(x) if isinstance(x, str) else x).alias(n) for n, x in zip(names, row)]) for row in rows])


def across_edges(df: DataFrame, contacts: DataFrame, n: int, width: int, vector: tuple[str, str] | None = None) -> DataFrame:
    """The halo of square tiles: ``df(tile, i, j, ...)`` of ``n`` by ``n`` cells as copies in the tiles they touch.

    ``contacts(tile, edge, to_tile, to_edge, reverse)`` lists both directions; ``reverse``
    says that places along the edges run against each other. A cell at distance d from an
    edge lies d cells beyond the other tile's edge. ``vector`` names the components along
    i and j, which are turned into the axes of the tile they come to. Edges without
    contact have no halo; corners between tiles are not filled.
    """
    zero = F.lit(0.0)
    u, v = (F.col(c) for c in vector) if vector else (zero, zero)
    places = F.filter(_on_edges(F.col("i"), F.col("j"), n - 1, n - 1, (u, v)), lambda p: p["depth"] < width)
    met = df.withColumn("at", F.explode(places)).withColumn("edge", F.col("at.edge")).join(contacts, ["tile", "edge"])
    along = F.when(F.col("reverse"), n - 1 - F.col("at.along")).otherwise(F.col("at.along"))
    side = F.when(F.col("reverse"), -F.col("at.side")).otherwise(F.col("at.side"))
    to, depth, inward = F.col("to_edge"), F.col("at.depth"), F.col("at.out")
    new = {
        "i": F.when(to == "W", -1 - depth).when(to == "E", n + depth).otherwise(along),
        "j": F.when(to == "S", -1 - depth).when(to == "N", n + depth).otherwise(along),
        "tile": F.col("to_tile"),
    }
    if vector:
        new[vector[0]] = F.when(to == "W", inward).when(to == "E", -inward).otherwise(side)
        new[vector[1]] = F.when(to == "S", inward).when(to == "N", -inward).otherwise(side)
    return met.select(*[new.get(c, F.col(c)).alias(c) for c in df.columns])


def shared_points(df: DataFrame, contacts: DataFrame, last: tuple[int, int], value: str, name: str = "across") -> DataFrame:
    """Points that lie on an edge, with the value the tile beyond has there: ``tile, edge, i, j, value, name``.

    ``df(tile, i, j, value)`` are staggered points from 0 to ``last`` along each axis
    (equal for corners). A point of two edges comes once an edge; edges without contact
    do not come.
    """
    zero = F.lit(0.0)
    places = F.filter(_on_edges(F.col("i"), F.col("j"), *last, (zero, zero)), lambda p: p["depth"] == 0)
    at = df.select("tile", F.explode(places).alias("at"), "i", "j", value).select("tile", F.col("at.edge").alias("edge"), F.col("at.along").alias("along"), "i", "j", value)
    length = F.when(F.col("edge").isin("W", "E"), last[1]).otherwise(last[0])
    met = at.join(contacts, ["tile", "edge"])
    along = F.when(F.col("reverse"), length - F.col("along")).otherwise(F.col("along"))
    theirs = met.select(F.col("to_tile").alias("tile"), F.col("to_edge").alias("edge"), along.alias("along"), F.col(value).alias(name))
    return at.join(theirs, ["tile", "edge", "along"]).select("tile", "edge", "i", "j", value, name)
