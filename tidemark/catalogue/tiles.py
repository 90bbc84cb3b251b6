"""Halos, folds and contacts of tiles: customers are the cells of small grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalogue.registry import query, table
from tidemark.operators import halo

GRID = """WITH g AS (SELECT c_custkey % 10 AS i, c_custkey // 10 % 10 AS j, max(c_acctbal) AS x, min(c_acctbal) AS u FROM customer GROUP BY ALL)"""
CUBE = """WITH g AS (SELECT c_custkey % 150 // 25 + 1 AS tile, c_custkey % 5 AS i, c_custkey // 5 % 5 AS j, max(c_acctbal) AS u, min(c_acctbal) AS v FROM customer GROUP BY ALL),
one AS (SELECT t AS tile, CASE WHEN t % 2 = 1 THEN 'E' ELSE 'N' END AS edge, t % 6 + 1 AS to_tile, CASE WHEN t % 2 = 1 THEN 'W' ELSE 'S' END AS to_edge, false AS reverse FROM range(1, 7) r(t)
 UNION ALL SELECT t, CASE WHEN t % 2 = 1 THEN 'N' ELSE 'E' END, (t + 1) % 6 + 1, CASE WHEN t % 2 = 1 THEN 'W' ELSE 'S' END, true FROM range(1, 7) r(t)),
k AS (SELECT * FROM one UNION ALL SELECT to_tile, to_edge, tile, edge, reverse FROM one)"""
FOLD = """
, f AS (SELECT i, j, x, u FROM g UNION ALL SELECT (9 - {east} - i + 10) % 10, 19 - {north} - j, x, -u FROM g WHERE j BETWEEN 8 - {north} AND 9 - {north})
SELECT i + 10 * s AS i, j, x, u FROM f, (VALUES (-1), (0), (1)) t(s) WHERE i + 10 * s BETWEEN -2 AND 11"""


def grid(spark, folder):
    k = F.col("c_custkey")
    cells = table(spark, folder, "customer").groupBy((k % 10).alias("i"), F.floor(k / 10 % 10).alias("j"))
    return cells.agg(F.max("c_acctbal").alias("x"), F.min("c_acctbal").alias("u"))


def cube(spark, folder):
    k = F.col("c_custkey")
    cells = table(spark, folder, "customer").groupBy(F.floor(k % 150 / 25 + 1).alias("tile"), (k % 5).alias("i"), F.floor(k / 5 % 5).alias("j"))
    return cells.agg(F.max("c_acctbal").alias("u"), F.min("c_acctbal").alias("v"))


@query(GRID + FOLD.format(east=0, north=0))
def halo_fold(spark, folder):
    return halo.with_halo(grid(spark, folder), "i", "j", (10, 10), 2, (True, False), fold=True, turned=("u",)).select("i", "j", "x", "u")


@query(GRID + FOLD.format(east=1, north=1))
def halo_fold_corner(spark, folder):
    out = halo.with_halo(grid(spark, folder), "i", "j", (10, 10), 2, (True, False), fold=True, turned=("u",), position="corner")
    return out.select("i", "j", "x", "u")


@query(GRID + """ SELECT i + 10 * s AS i, j + 10 * t AS j, x FROM g, (VALUES (-1), (0), (1)) a(s), (VALUES (-1), (0), (1)) b(t)
WHERE i + 10 * s BETWEEN -1 AND 10 AND j + 10 * t BETWEEN -1 AND 10""")
def halo_doubly_cyclic(spark, folder):
    return halo.with_halo(grid(spark, folder), "i", "j", (10, 10), 1, (True, True)).select("i", "j", "x")


@query("SELECT tile, edge, to_tile, to_edge, reverse FROM (" + CUBE + " SELECT * FROM k)")
def cube_contacts(spark, folder):
    return halo.cube_contacts(spark)


@query(CUBE + """, e AS (SELECT *, 'W' AS edge, i AS d, j AS p, -u AS o, v AS s FROM g UNION ALL SELECT *, 'E', 4 - i, j, u, v FROM g
 UNION ALL SELECT *, 'S', j, i, -v, u FROM g UNION ALL SELECT *, 'N', 4 - j, i, v, u FROM g),
m AS (SELECT to_tile, to_edge, d, o, CASE WHEN reverse THEN 4 - p ELSE p END AS p, CASE WHEN reverse THEN -s ELSE s END AS s FROM e JOIN k USING (tile, edge) WHERE d < 2)
SELECT to_tile AS tile, CASE to_edge WHEN 'W' THEN -1 - d WHEN 'E' THEN 5 + d ELSE p END AS i, CASE to_edge WHEN 'S' THEN -1 - d WHEN 'N' THEN 5 + d ELSE p END AS j,
 CASE to_edge WHEN 'W' THEN o WHEN 'E' THEN -o ELSE s END AS u, CASE to_edge WHEN 'S' THEN o WHEN 'N' THEN -o ELSE s END AS v FROM m""")
def halo_cube_vectors(spark, folder):
    return halo.across_edges(cube(spark, folder), halo.cube_contacts(spark), 5, 2, vector=("u", "v"))


@query(CUBE + """, e AS (SELECT tile, 'W' AS edge, j AS p, i, j, u FROM g WHERE i = 0 UNION ALL SELECT tile, 'E', j, i, j, u FROM g WHERE i = 4
 UNION ALL SELECT tile, 'S', i, i, j, u FROM g WHERE j = 0 UNION ALL SELECT tile, 'N', i, i, j, u FROM g WHERE j = 4)
SELECT a.tile, a.edge, a.i, a.j, a.u, b.u AS across FROM e a JOIN k ON k.tile = a.tile AND k.edge = a.edge
JOIN e b ON b.tile = to_tile AND b.edge = to_edge AND b.p = CASE WHEN reverse THEN 4 - a.p ELSE a.p END""")
def boundary_points(spark, folder):
    points = cube(spark, folder).drop("v")
    return halo.shared_points(points, halo.cube_contacts(spark), (4, 4), "u")
