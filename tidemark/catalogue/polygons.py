"""Overlaps of two curvilinear grids, one cell a customer and one a part."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.catalogue.registry import query, table
from tidemark.operators import polygons, regrid

#: Shares of cells that are only rounding: all others count towards a cell's sum.
SLIVER = 1e-12


def _cells(df: DataFrame, key: str, name: str, rows: int, south: float, lean: float) -> DataFrame:
    """Closed rings of leaning cells from ``south`` to its mirror image, whose corners wave by two degrees."""
    columns = df.count() // rows
    n = F.col(key)
    i, j = F.floor(n / rows), n % rows
    height = -2 * south / rows

    def corner(a: Column, b: Column) -> tuple[Column, Column]:
        lon = 2 * math.pi * (a + lean * F.sin(b)) / columns
        wave = F.when(b.between(1, rows - 1), 2.0 * F.sin(6 * math.pi * a / columns)).otherwise(0.0)
        return lon, F.radians(south + height * b + wave)

    corners = [corner(i, j), corner(i + 1, j), corner(i + 1, j + 1), corner(i, j + 1)]
    cells = df.where(n < columns * rows)
    return cells.select(F.col(key).alias(name), F.array(*[c[0] for c in corners]).alias("lon"), F.array(*[c[1] for c in corners]).alias("lat"))


def _grids(spark, folder, south):
    a = _cells(table(spark, folder, "customer").select("c_custkey"), "c_custkey", "src", 12, south, 0.4)
    b = _cells(table(spark, folder, "part").select("p_partkey"), "p_partkey", "dst", 8, south, -0.7)
    return a, b


def _corners_sql(source: str, key: str, rows: int, south: float, lean: float) -> str:
    """Four rows a cell: ``cell, k, x, y`` in order around, ``n`` cells of the table."""
    return f"""SELECT cell, k, n, 2 * pi() * (i + {lean} * sin(j)) / c AS x, radians({south} + {-2 * south / rows} * j + CASE WHEN j BETWEEN 1 AND {rows - 1} THEN 2 * sin(6 * pi() * i / c) ELSE 0 END) AS y
FROM (SELECT {key} AS cell, k, n, n // {rows} AS c, {key} // {rows} + CASE WHEN k IN (1, 2) THEN 1 ELSE 0 END AS i, {key} % {rows} + CASE WHEN k >= 2 THEN 1 ELSE 0 END AS j
  FROM {source}, (SELECT count(*) AS n FROM {source}), range(4) t(k)) WHERE cell < c * {rows}"""


def _both_sql(south: float) -> str:
    a, b = _corners_sql("customer", "c_custkey", 12, south, 0.4), _corners_sql("part", "p_partkey", 8, south, -0.7)
    return f"WITH v AS (SELECT 'a' AS side, * FROM ({a}) UNION ALL SELECT 'b', * FROM ({b}))"


def _dot(p: str, q: str) -> str:
    return f"({p}.x * {q}.x + {p}.y * {q}.y + {p}.z * {q}.z)"


def _excess(p: str, q: str, r: str) -> str:
    triple = f"({p}.x * ({q}.y * {r}.z - {q}.z * {r}.y) + {p}.y * ({q}.z * {r}.x - {q}.x * {r}.z) + {p}.z * ({q}.x * {r}.y - {q}.y * {r}.x))"
    return f"2 * atan2({triple}, 1 + {_dot(p, q)} + {_dot(q, r)} + {_dot(r, p)})"


def _totals(overlap: DataFrame, spark, folder, *more: Column) -> tuple[DataFrame, Column]:
    """Sums of what the cells of both sides share, and the number of cells of a side's table."""
    side = lambda name, key: F.struct(F.lit(name).alias("side"), F.col(key).alias("cell"))
    both = overlap.withColumn("s", F.explode(F.array(side("a", "src"), side("b", "dst"))))
    counts = [F.lit(table(spark, folder, t).count()) for t in ("customer", "part")]
    return both.groupBy("s.side", "s.cell").agg(F.sum("w").alias("w"), *more), F.when(F.col("side") == "a", counts[0]).otherwise(counts[1])


@query(_both_sql(-90.0) + f""", u AS (SELECT side, cell, k, n, cos(y) * cos(x) AS x, cos(y) * sin(x) AS y, sin(y) AS z FROM v)
SELECT a.side, a.cell, round(abs({_excess("a", "b", "c")} + {_excess("a", "c", "d")}) * a.n / (4 * pi()), 4) AS area
FROM u a JOIN u b ON b.side = a.side AND b.cell = a.cell AND b.k = 1 JOIN u c ON c.side = a.side AND c.cell = a.cell AND c.k = 2 JOIN u d ON d.side = a.side AND d.cell = a.cell AND d.k = 3 WHERE a.k = 0""")
def xgrid_great_circle(spark, folder):
    """What each cell of both grids shares with the other grid adds up to the cell: great circles from pole to pole."""
    a, b = _grids(spark, folder, -90.0)
    out, n = _totals(polygons.cell_overlaps(a, b, 0.3, least=SLIVER), spark, folder)
    return out.select("side", "cell", F.round(F.col("w") * n / (4 * math.pi), 4).alias("area"))


_MEAN = "CASE WHEN abs(b.y - a.y) < 1e-9 THEN cos(a.y) + a.y * sin(a.y) ELSE (2 * sin(b.y) - b.y * cos(b.y) - 2 * sin(a.y) + a.y * cos(a.y)) / (b.y - a.y) END"


@query(_both_sql(-60.0) + f""" SELECT a.side, a.cell, round(-sum((b.x - a.x) * sin((a.y + b.y) / 2) * CASE WHEN a.y = b.y THEN 1 ELSE sin((b.y - a.y) / 2) / ((b.y - a.y) / 2) END) * a.n / (4 * pi()), 4) AS area,
round(-sum((b.x - a.x) * {_MEAN}) * a.n / (4 * pi()), 4) AS moment FROM v a JOIN v b ON b.side = a.side AND b.cell = a.cell AND b.k = (a.k + 1) % 4 GROUP BY a.side, a.cell, a.n""")
def xgrid_lon_lat(spark, folder):
    """The same between 60 degrees south and north with edges straight in longitude and latitude, and the latitudes of the shared centres."""
    a, b = _grids(spark, folder, -60.0)
    out, n = _totals(polygons.cell_overlaps(a, b, 0.2, edges="lon_lat", least=SLIVER), spark, folder, F.sum(F.col("w") * F.col("lat")).alias("m"))
    scaled = lambda c: F.round(F.col(c) * n / (4 * math.pi), 4)
    return out.select("side", "cell", scaled("w").alias("area"), scaled("m").alias("moment"))


@query(_both_sql(-90.0) + f""", u AS (SELECT side, cell, k, n, cos(y) * cos(x) AS x, cos(y) * sin(x) AS y, sin(y) AS z FROM v WHERE side = 'a'),
s AS (SELECT a.cell, abs({_excess("a", "b", "c")} + {_excess("a", "c", "d")}) AS area
FROM u a JOIN u b ON b.cell = a.cell AND b.k = 1 JOIN u c ON c.cell = a.cell AND c.k = 2 JOIN u d ON d.cell = a.cell AND d.k = 3 WHERE a.k = 0)
SELECT count(*) AS n, round(sum(area * (c_acctbal + 1000)), 1) AS total FROM s JOIN customer ON c_custkey = cell""")
def polygon_flux_total(spark, folder):
    """A field of the customers' cells on the parts' cells keeps its integral."""
    a, b = _grids(spark, folder, -90.0)
    overlap = polygons.cell_overlaps(a, b, 0.3)
    field = table(spark, folder, "customer").select(F.col("c_custkey").alias("src"), (F.col("c_acctbal") + 1000).alias("x"))
    means = regrid.conserve_boxes(field, overlap, "x", target=b)
    whole = means.join(polygons.cell_areas(b, "dst"), "dst").agg(F.sum(F.col("value") * F.col("area")).alias("total"))
    return whole.crossJoin(a.agg(F.count("*").alias("n"))).select("n", F.round("total", 1).alias("total"))
