"""Compression by gathering, and restarts of the strips along the edges of a region.

A gathered variable keeps the cells that a mask leaves, numbered in each tile: a list of
cells, written once, and values by number. It is expanded again by a join with the list.
A region's restart keeps strips of cells along its edges; they are put back into the
fields they were cut from. Both keep the checksums of all their columns, reals by bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.store import read_restart, save_restart

EDGES = ("W", "E", "S", "N")


def cell_list(cells: DataFrame, mask: Column, tile: str = "tile", i: str = "i", j: str = "j") -> DataFrame:
    """``tile, i, j, number``: the masked-in cells of each tile from 0, row by row.

    Numbers are counted within a row of the tile and added to the counts of the rows
    before, so that a tile is not sorted in one task.
    """
    kept = cells.where(mask).select(tile, i, j).distinct()
    rows = kept.groupBy(tile, j).agg(F.count("*").alias("n"))
    before = Window.partitionBy(tile).orderBy(j).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(F.col(tile).alias("__tile"), F.col(j).alias("__j"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy(tile, j).orderBy(i)) - 1
    joined = kept.withColumn("__place", place).join(rows, F.col(tile).eqNullSafe(F.col("__tile")) & (F.col(j) == F.col("__j")))
    return joined.select(tile, i, j, (F.col("__before") + F.col("__place")).alias("number"))


def write_gathered(df: DataFrame, path: str, mask: Column, tile: str = "tile", i: str = "i", j: str = "j", cells: DataFrame | None = None) -> None:
    """Write ``df(tile, i, j, ...)`` without the cells that ``mask`` leaves out.

    The list of cells is made of ``df`` or of ``cells`` (one row a cell); rows of cells that
    are not listed are left out. Further axes and values stay as columns.
    """
    held = cell_list(df if cells is None else cells, mask, tile, i, j)
    held.write.parquet(f"{path}/cells")
    spark = df.sparkSession
    held = spark.read.schema(held.schema).parquet(f"{path}/cells")
    save_restart(df.join(held, [tile, i, j]).drop(i, j), f"{path}/values", [c for c in df.columns if c not in (i, j)])


def read_gathered(spark: SparkSession, path: str, tile: str = "tile", grid: DataFrame | None = None, fill: dict | None = None, where: Column | None = None) -> DataFrame:
    """A gathered variable as ``(tile, i, j, ...)``; checksums are compared.

    With ``grid(tile, i, j)`` every cell of it has a row, those left out by the mask with
    ``fill`` by column (else null). ``where`` is a condition on tile and cells and is met
    in the list before the values are joined.
    """
    held = spark.read.parquet(f"{path}/cells")
    values = read_restart(spark, f"{path}/values")
    if where is not None:
        held = held.where(where)
    out = held.join(values, [tile, "number"]).drop("number")
    if grid is None:
        return out
    out = grid.join(out, [c for c in held.columns if c != "number"], "left")
    return out.fillna(fill) if fill else out


def edge_strips(df: DataFrame, box: tuple[int, int, int, int], width: int, i: str = "i", j: str = "j") -> DataFrame:
    """Strips of ``width`` cells along the edges of a box ``(i0, i1, j0, j1)``, both ends included: ``edge`` and ``df``'s columns.

    West and east strips are as long as the box, south and north ones too: a cell in a
    corner comes in both, as each edge's file holds all it needs.
    """
    i0, i1, j0, j1 = box
    x, y = F.col(i), F.col(j)
    inside = x.between(i0, i1) & y.between(j0, j1)
    on = ((x < i0 + width), (x > i1 - width), (y < j0 + width), (y > j1 - width))
    edges = F.filter(F.array(*[F.when(c, F.lit(e)) for e, c in zip(EDGES, on)]), lambda e: e.isNotNull())
    return df.where(inside).select(F.explode(edges).alias("edge"), *df.columns)


def save_region(df: DataFrame, path: str, box: tuple[int, int, int, int], width: int, i: str = "i", j: str = "j") -> None:
    """Write the strips of a box, with checksums."""
    save_restart(edge_strips(df, box, width, i, j), path, [c for c in df.columns])


def restore_region(spark: SparkSession, path: str, df: DataFrame, keys: list[str], edges: tuple[str, ...] = EDGES) -> DataFrame:
    """``df`` with the saved strips of ``edges`` in place of its cells; other cells stay, saved ones it lacks come in.

    ``keys`` are the columns that name a cell (and level); of the strips only the edges
    asked for are read.
    """
    saved = read_restart(spark, path).where(F.col("edge").isin(*edges)).drop("edge").dropDuplicates(keys)
    rest = df.join(saved.select(*keys), keys, "left_anti")
    return rest.select(df.columns).unionByName(saved.select(df.columns))
