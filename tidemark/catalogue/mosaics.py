"""A cube of six tiles whose cells are customers: contacts from corners, gradients, slopes on the sphere."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.catalogue.registry import query, table
from tidemark.operators import halo, mosaic
from tidemark.operators import neighbours as nb

#: Each tile's centre and directions of i and j; neighbours' edges agree as ``halo.cube_contacts`` says.
FACES = (
    ((1, 0, 0), (0, 1, 0), (0, 0, 1)), ((0, 1, 0), (-1, 0, 0), (0, 0, 1)), ((0, 0, 1), (-1, 0, 0), (0, -1, 0)),
    ((-1, 0, 0), (0, 0, -1), (0, -1, 0)), ((0, -1, 0), (0, 0, -1), (1, 0, 0)), ((0, 0, -1), (0, 1, 0), (1, 0, 0)),
)


def _size(spark, folder) -> int:
    return math.isqrt(table(spark, folder, "customer").count() // 6)


def cube_corners(spark, n: int) -> DataFrame:
    """``tile, i, j, lon, lat``: grid points at equal angles, ``n`` cells along a tile's edge."""
    k = F.col("id")
    points = spark.range(6 * (n + 1) ** 2).select((F.floor(k / (n + 1) ** 2) + 1).alias("tile"), (k % (n + 1)).alias("i"), (F.floor(k / (n + 1)) % (n + 1)).alias("j"))
    a, b = (F.tan(math.pi / 4 * (2 * F.col(c) / n - 1)) for c in ("i", "j"))
    faces = F.array(*[F.array(*[F.lit(float(x)) for v in face for x in v]) for face in FACES])
    face = lambda m: F.element_at(F.element_at(faces, F.col("tile").cast("int")), m)
    x, y, z = (face(m) + a * face(m + 3) + b * face(m + 6) for m in (1, 2, 3))
    return points.select("tile", "i", "j", F.atan2(y, x).alias("lon"), F.atan2(z, F.sqrt(x * x + y * y)).alias("lat"))


def _field(spark, folder, n: int) -> DataFrame:
    k = F.col("c_custkey")
    cells = table(spark, folder, "customer").where(k < 6 * n * n)
    return cells.select((F.floor(k / (n * n)) + 1).alias("tile"), (k % n).alias("i"), (F.floor(k / n) % n).alias("j"), F.col("c_acctbal").alias("x"))


@query("""
WITH n AS (SELECT floor(sqrt(count(*) // 6))::BIGINT AS n FROM customer),
one AS (SELECT t AS tile, CASE WHEN t % 2 = 1 THEN 'E' ELSE 'N' END AS edge, t % 6 + 1 AS to_tile, CASE WHEN t % 2 = 1 THEN 'W' ELSE 'S' END AS to_edge, false AS reverse FROM range(1, 7) r(t)
 UNION ALL SELECT t, CASE WHEN t % 2 = 1 THEN 'N' ELSE 'E' END, (t + 1) % 6 + 1, CASE WHEN t % 2 = 1 THEN 'W' ELSE 'S' END, true FROM range(1, 7) r(t))
SELECT k.*, 0::BIGINT AS first, n - 1 AS last FROM (SELECT * FROM one UNION ALL SELECT to_tile, to_edge, tile, edge, reverse FROM one) k, n""")
def mosaic_contacts(spark, folder):
    """The 24 contacts of a cube as large as the customers are many, from its grid points alone."""
    return mosaic.find_contacts(cube_corners(spark, _size(spark, folder))).select("tile", "edge", "to_tile", "to_edge", "reverse", "first", "last")


_CUBE_SQL = f"""
WITH p AS (SELECT floor(sqrt(count(*) // 6))::BIGINT AS n FROM customer),
faces(tile, cx, cy, cz, ax, ay, az, bx, by_, bz) AS (VALUES {", ".join(f"({t}, {', '.join(str(x) for v in face for x in v)})" for t, face in enumerate(FACES, 1))}),
cells AS (SELECT c_custkey // (n * n) + 1 AS tile, c_custkey % n AS i, c_custkey // n % n AS j, c_acctbal AS v, n FROM customer, p WHERE c_custkey < 6 * n * n),
flat AS (SELECT tile, i, j, v, k, tan(pi() / 4 * (2.0 * (i + CASE WHEN k IN (1, 2) THEN 1 ELSE 0 END) / n - 1)) AS a, tan(pi() / 4 * (2.0 * (j + CASE WHEN k >= 2 THEN 1 ELSE 0 END) / n - 1)) AS b FROM cells, range(4) t(k)),
raw AS (SELECT tile, i, j, v, k, cx + a * ax + b * bx AS x, cy + a * ay + b * by_ AS y, cz + a * az + b * bz AS z FROM flat JOIN faces USING (tile)),
cc AS (SELECT tile, i, j, v, k, x / r AS x, y / r AS y, z / r AS z, round(x / r, 6) || ' ' || round(y / r, 6) || ' ' || round(z / r, 6) AS raw_key FROM (SELECT *, sqrt(x * x + y * y + z * z) AS r FROM raw)),
ck AS (SELECT * EXCLUDE (raw_key), replace(replace(' ' || raw_key || ' ', ' -0.0 ', ' 0.0 '), ' -0.0 ', ' 0.0 ') AS node FROM cc),
mid AS (SELECT tile, i, j, any_value(v) AS v, sum(x) / sqrt(sum(x) ** 2 + sum(y) ** 2 + sum(z) ** 2) AS mx, sum(y) / sqrt(sum(x) ** 2 + sum(y) ** 2 + sum(z) ** 2) AS my, sum(z) / sqrt(sum(x) ** 2 + sum(y) ** 2 + sum(z) ** 2) AS mz FROM ck GROUP BY ALL),
sides AS (SELECT a.tile, a.i, a.j, a.node AS one, b.node AS two FROM ck a JOIN ck b ON a.tile = b.tile AND a.i = b.i AND a.j = b.j AND b.k = (a.k + 1) % 4),
across AS (SELECT s.one, s.two, m.v AS v1, o.v AS v2, m.mx + o.mx AS x, m.my + o.my AS y, m.mz + o.mz AS z FROM sides s JOIN sides t ON s.one = t.two AND s.two = t.one AND s.tile < t.tile
  JOIN mid m ON m.tile = s.tile AND m.i = s.i AND m.j = s.j JOIN mid o ON o.tile = t.tile AND o.i = t.i AND o.j = t.j),
ends AS (SELECT one AS node, (v1 + v2) / 2 AS q, x, y, z FROM across UNION ALL SELECT two, (v1 + v2) / 2, x, y, z FROM across),
spots AS (SELECT node, any_value(x) AS x, any_value(y) AS y, any_value(z) AS z, count(*) AS n, count(DISTINCT tile) AS tiles, avg(v) AS mean FROM ck GROUP BY node),
weighed AS (SELECT node, sum(q / d) / sum(1 / d) AS q FROM (SELECT e.node, q, acos(least(1, (e.x * s.x + e.y * s.y + e.z * s.z) / sqrt(e.x ** 2 + e.y ** 2 + e.z ** 2))) AS d FROM ends e JOIN spots s USING (node)) GROUP BY node),
at_node AS (SELECT node, CASE WHEN n = 4 AND tiles = 2 THEN q ELSE mean END AS q FROM spots LEFT JOIN weighed USING (node)),
ring AS (SELECT a.tile, a.i, a.j, a.x, a.y, a.z, b.x AS u, b.y AS v, b.z AS w, (qa.q + qb.q) / 2 AS q FROM ck a JOIN ck b ON a.tile = b.tile AND a.i = b.i AND a.j = b.j AND b.k = (a.k + 1) % 4 JOIN at_node qa ON qa.node = a.node JOIN at_node qb ON qb.node = b.node),
n3 AS (SELECT *, y * w - z * v AS nx, z * u - x * w AS ny, x * v - y * u AS nz, acos(least(1, x * u + y * v + z * w)) AS len FROM ring),
g AS (SELECT tile, i, j, -sum(q * len * nx / sin(len)) AS gx, -sum(q * len * ny / sin(len)) AS gy, -sum(q * len * nz / sin(len)) AS gz FROM n3 GROUP BY ALL),
quad AS (SELECT tile, i, j, max(x) FILTER (k = 0) AS x0, max(y) FILTER (k = 0) AS y0, max(z) FILTER (k = 0) AS z0, max(x) FILTER (k = 1) AS x1, max(y) FILTER (k = 1) AS y1, max(z) FILTER (k = 1) AS z1,
  max(x) FILTER (k = 2) AS x2, max(y) FILTER (k = 2) AS y2, max(z) FILTER (k = 2) AS z2, max(x) FILTER (k = 3) AS x3, max(y) FILTER (k = 3) AS y3, max(z) FILTER (k = 3) AS z3 FROM ck GROUP BY ALL),
area AS (SELECT tile, i, j, 2 * atan2(x0 * (y1 * z2 - z1 * y2) + y0 * (z1 * x2 - x1 * z2) + z0 * (x1 * y2 - y1 * x2), 1 + x0 * x1 + y0 * y1 + z0 * z1 + x1 * x2 + y1 * y2 + z1 * z2 + x2 * x0 + y2 * y0 + z2 * z0)
  + 2 * atan2(x0 * (y2 * z3 - z2 * y3) + y0 * (z2 * x3 - x2 * z3) + z0 * (x2 * y3 - y2 * x3), 1 + x0 * x2 + y0 * y2 + z0 * z2 + x2 * x3 + y2 * y3 + z2 * z3 + x3 * x0 + y3 * y0 + z3 * z0) AS s FROM quad)
SELECT tile, i, j, round((-my * gx + mx * gy) / sqrt(mx * mx + my * my) / s, 2) AS east, round((-mz * mx * gx - mz * my * gy) / sqrt(mx * mx + my * my) / s + sqrt(mx * mx + my * my) * gz / s, 2) AS north
FROM g JOIN area USING (tile, i, j) JOIN mid USING (tile, i, j) WHERE mx * mx + my * my > 1e-12"""


@query(_CUBE_SQL)
def gradient_cube(spark, folder):
    """Gradients on the whole cube, edges and corners included; a cell whose centre is a pole has no east."""
    n = _size(spark, folder)
    out = mosaic.tile_gradient(_field(spark, folder, n), cube_corners(spark, n), "x")
    return out.where("east is not null").select("tile", "i", "j", F.round("east", 2).alias("east"), F.round("north", 2).alias("north"))


@query("""
WITH n AS (SELECT floor(sqrt(count(*) // 6))::BIGINT AS n FROM customer),
g AS (SELECT c_custkey // (n * n) + 1 AS tile, c_custkey % n AS i, c_custkey // n % n AS j, c_acctbal AS x, n FROM customer, n WHERE c_custkey < 6 * n * n),
one AS (SELECT t AS tile, CASE WHEN t % 2 = 1 THEN 'E' ELSE 'N' END AS edge, t % 6 + 1 AS to_tile, CASE WHEN t % 2 = 1 THEN 'W' ELSE 'S' END AS to_edge, false AS reverse FROM range(1, 7) r(t)
 UNION ALL SELECT t, CASE WHEN t % 2 = 1 THEN 'N' ELSE 'E' END, (t + 1) % 6 + 1, CASE WHEN t % 2 = 1 THEN 'W' ELSE 'S' END, true FROM range(1, 7) r(t)),
k AS (SELECT * FROM one UNION ALL SELECT to_tile, to_edge, tile, edge, reverse FROM one),
e AS (SELECT *, 'W' AS edge, j AS p FROM g WHERE i = 0 UNION ALL SELECT *, 'E', j FROM g WHERE i = n - 1 UNION ALL SELECT *, 'S', i FROM g WHERE j = 0 UNION ALL SELECT *, 'N', i FROM g WHERE j = n - 1),
m AS (SELECT to_tile, to_edge, x, n, CASE WHEN reverse THEN n - 1 - p ELSE p END AS p FROM e JOIN k USING (tile, edge))
SELECT to_tile AS tile, CASE to_edge WHEN 'W' THEN -1 WHEN 'E' THEN n ELSE p END AS i, CASE to_edge WHEN 'S' THEN -1 WHEN 'N' THEN n ELSE p END AS j, x FROM m""")
def mosaic_halo(spark, folder):
    """Halos by contacts that were found from coordinates."""
    n = _size(spark, folder)
    contacts = mosaic.find_contacts(cube_corners(spark, n)).select("tile", "edge", "to_tile", "to_edge", "reverse")
    return halo.across_edges(_field(spark, folder, n), contacts, n, 1)


LON_LAT = """
WITH g AS (SELECT l_suppkey AS i, l_linenumber AS j, radians((l_suppkey * 7.0 + l_suppkey % 3) % 360) AS lon, radians(-70 + 20 * l_linenumber + l_linenumber % 2) AS lat, max(l_quantity) AS x FROM lineitem WHERE l_suppkey <= 50 GROUP BY ALL)"""


def _lon_lat(spark, folder):
    i, j = F.col("l_suppkey"), F.col("l_linenumber")
    df = table(spark, folder, "lineitem").where(i <= 50).groupBy(i.alias("i"), j.alias("j")).agg(F.max("l_quantity").alias("x"))
    lon, lat = F.radians((F.col("i") * 7.0 + F.col("i") % 3) % 360), F.radians(-70 + 20 * F.col("j") + F.col("j") % 2)
    return df.select("i", "j", lon.alias("lon"), lat.alias("lat"), "x")


@query(LON_LAT + """, d AS (SELECT *, coalesce(lead(x) OVER e, x) - coalesce(lag(x) OVER e, x) AS dx, coalesce(lead(lon) OVER e, lon) - coalesce(lag(lon) OVER e, lon) AS dl,
 coalesce(lead(x) OVER n, x) - coalesce(lag(x) OVER n, x) AS dy, coalesce(lead(lat) OVER n, lat) - coalesce(lag(lat) OVER n, lat) AS dp FROM g WINDOW e AS (PARTITION BY j ORDER BY i), n AS (PARTITION BY i ORDER BY j))
SELECT i, j, round(dx / ((dl - CASE WHEN dl > pi() THEN 2 * pi() WHEN dl < -pi() THEN -2 * pi() ELSE 0 END) * cos(lat)), 4) AS east, round(dy / dp, 4) AS north FROM d""")
def gradient_lon_lat(spark, folder):
    """Zonal and meridional slopes on a grid of uneven steps, one-sided at its ends."""
    out = nb.gradient_lon_lat(_lon_lat(spark, folder), [], "i", "j", "x")
    return out.select("i", "j", F.round("east", 4).alias("east"), F.round("north", 4).alias("north"))
