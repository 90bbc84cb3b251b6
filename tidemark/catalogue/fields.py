"""Field arithmetic and overrides on line items and orders."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.catalogue.registry import query, table
from tidemark.functions.tables import scratch_folder
from tidemark.operators import fields as op
from tidemark.sources import arrays, gathering


def lines(spark, folder):
    return table(spark, folder, "lineitem")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 0.0::DOUBLE ELSE (l_linenumber - 1) * l_quantity END AS x FROM lineitem")
def coupler_rescale(spark, folder):
    return lines(spark, folder).select("l_orderkey", "l_linenumber", op.rescale(F.col("l_quantity"), (F.col("l_linenumber") - 1).cast("double")).alias("x"))


@query("""
WITH a AS (SELECT l_orderkey, sum(l_quantity) AS x FROM lineitem WHERE l_linenumber <= 2 GROUP BY ALL), b AS (SELECT l_orderkey, sum(l_quantity) AS y FROM lineitem WHERE l_linenumber = 3 GROUP BY ALL)
SELECT l_orderkey, 0.5 * x + 2.0 * coalesce(y, 0) AS x FROM a LEFT JOIN b USING (l_orderkey)""")
def coupler_increment(spark, folder):
    df = lines(spark, folder)
    a = df.where("l_linenumber <= 2").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("x"))
    b = df.where("l_linenumber = 3").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("x"))
    return op.increment(a, b, ["l_orderkey"], "x", scale=2.0, scale_prev=0.5)


@query("""
WITH RECURSIVE k AS (SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS r FROM lineitem),
f AS (SELECT o_orderkey AS l_orderkey, 0 AS r, 64.0::DOUBLE AS x FROM orders UNION ALL SELECT f.l_orderkey, k.r, f.x * 0.5 + 0.25 * k.l_quantity FROM f JOIN k ON k.l_orderkey = f.l_orderkey AND k.r = f.r + 1)
SELECT l_orderkey, round(arg_max(x, r), 6) AS x FROM f GROUP BY l_orderkey""")
def coupler_weighted_increment(spark, folder):
    base = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(64.0).alias("x"))
    layers = lines(spark, folder).select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), F.lit(0.25).alias("w"))
    out = op.weighted_increment(base, layers, ["l_orderkey"], "l_linenumber", "x", "w", scale_prev=0.5)
    return out.select("l_orderkey", F.round("x", 6).alias("x"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount >= 0.05 THEN l_quantity END AS x FROM lineitem")
def field_mask(spark, folder):
    return lines(spark, folder).select("l_orderkey", "l_linenumber", op.masked(F.col("l_quantity"), F.col("l_discount") >= 0.05).alias("x"))


@query("SELECT l_orderkey, l_linenumber, l_linenumber * 0.5 + 10.0 AS x FROM lineitem WHERE l_quantity BETWEEN 5 AND 40 AND l_quantity <> 13")
def unpack_valid(spark, folder):
    df = lines(spark, folder).where(op.is_valid(F.col("l_quantity"), 5, 40, 13))
    return df.select("l_orderkey", "l_linenumber", op.unpack(F.col("l_linenumber"), 0.5, 10.0).alias("x"))


POINTS = "WITH p AS (SELECT row_number() OVER (ORDER BY l_suppkey, l_linenumber) AS point, l_suppkey, l_linenumber FROM (SELECT DISTINCT l_suppkey, l_linenumber FROM lineitem WHERE l_suppkey % 3 = 0))"


def _points(spark, folder):
    df = lines(spark, folder).where("l_suppkey % 3 = 0").select("l_suppkey", "l_linenumber").distinct()
    return df.withColumn("point", F.col("l_suppkey") * 10 + F.col("l_linenumber"))


def _grid(spark, folder):
    return lines(spark, folder).groupBy("l_suppkey", "l_linenumber").agg(F.max("l_quantity").alias("x"))


@query("SELECT l_suppkey * 10 + l_linenumber AS point, max(l_quantity) AS x FROM lineitem WHERE l_suppkey % 3 = 0 GROUP BY ALL")
def sg_to_ug(spark, folder):
    return op.to_points(_grid(spark, folder), _points(spark, folder), ["l_suppkey", "l_linenumber"]).select("point", "x")


@query("SELECT l_suppkey, l_linenumber, CASE WHEN l_suppkey % 3 = 0 THEN max(l_quantity) ELSE -999.0::DOUBLE END AS x FROM lineitem GROUP BY l_suppkey, l_linenumber")
def ug_to_sg(spark, folder):
    keys = ["l_suppkey", "l_linenumber"]
    points, grid = _points(spark, folder), _grid(spark, folder)
    values = op.to_points(grid, points, keys).select("point", "x")
    return op.to_grid(values, points, grid, keys, "x", fill=-999.0)


@query("SELECT DISTINCT l_suppkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = l.l_suppkey AND s.s_acctbal < 0)")
def mask_table_anti(spark, folder):
    blocks = lines(spark, folder).select("l_suppkey", "l_linenumber").distinct()
    masked = table(spark, folder, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return op.masked_blocks(blocks, masked, ["l_suppkey"])


@query("""
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)
UNION ALL SELECT -o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 10 = 0""")
def remove_and_add(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    gone = lines(spark, folder).where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    more = o.where("o_orderstatus = 'F' AND o_orderkey % 10 = 0").withColumn("o_orderkey", -F.col("o_orderkey"))
    return op.remove_and_add(o, gone, more, "o_orderkey").select("o_orderkey", "o_totalprice")


TABLE = [
    op.Override("ATM", "price", "file", 2.0, (10.0, 40.0, 1.0, 4.0)),
    op.Override("ATM", "price", "file", 99.0),
    op.Override("ATM", "flux", None, 7.5),
    op.Override("LND", "price", "file", 3.0, (10.0, 40.0, 1.0, 4.0), outside=True),
    op.Override("OCN", "price", "file", 0.5),
]


def _model(spark, folder):
    return lines(spark, folder).groupBy("l_suppkey", "l_linenumber").agg(F.max("l_quantity").alias("x")).withColumn("lon", F.col("l_suppkey").cast("double")).withColumn("lat", F.col("l_linenumber").cast("double"))


def _file(spark, folder):
    return lines(spark, folder).where("l_suppkey % 4 <> 0").groupBy("l_suppkey", "l_linenumber").agg(F.min("l_quantity").alias("x"))


MODEL = "WITH m AS (SELECT l_suppkey, l_linenumber, max(l_quantity) AS x, min(l_quantity) FILTER (l_suppkey % 4 <> 0) AS f, l_suppkey BETWEEN 10 AND 40 AND l_linenumber BETWEEN 1 AND 4 AS inside FROM lineitem GROUP BY ALL)"


def _overridden(spark, folder, grid, field="price"):
    keys = ["l_suppkey", "l_linenumber"]
    return op.override(_model(spark, folder), TABLE, grid, field, "x", _file(spark, folder), keys).select(*keys, "x")


@query(MODEL + " SELECT l_suppkey, l_linenumber, 7.5::DOUBLE AS x FROM m")
def override_const(spark, folder):
    return _overridden(spark, folder, "ATM", "flux")


@query(MODEL + " SELECT l_suppkey, l_linenumber, CASE WHEN inside AND f IS NOT NULL THEN f * 2 ELSE x END AS x FROM m")
def override_first_match(spark, folder):
    return _overridden(spark, folder, "ATM")


@query(MODEL + " SELECT l_suppkey, l_linenumber, CASE WHEN NOT inside AND f IS NOT NULL THEN f * 3 ELSE x END AS x FROM m")
def override_region(spark, folder):
    return _overridden(spark, folder, "LND")


@query(MODEL + " SELECT l_suppkey, l_linenumber, f * 0.5 AS x FROM m")
def override_whole(spark, folder):
    return _overridden(spark, folder, "OCN")


COLUMNS = "WITH s AS (SELECT p_brand AS col, n AS k, n * 10.0 AS top, n * 10.0 + 10 AS bottom, max(p_size)::DOUBLE + n AS q FROM part, range(6) t(n) GROUP BY p_brand, n), t AS (SELECT DISTINCT p_brand AS col, n AS k, n * 7.0 AS top, n * 7.0 + 7 AS bottom FROM part, range(8) t(n))"


def _column(spark, folder, n, step, q=True):
    df = table(spark, folder, "part").groupBy(F.col("p_brand").alias("col")).agg(F.max("p_size").cast("double").alias("m"))
    df = df.select("col", "m", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    df = df.withColumn("top", F.col("k") * step).withColumn("bottom", F.col("k") * step + step)
    return df.select("col", "top", "bottom", (F.col("m") + F.col("k")).alias("q")) if q else df.select("col", "k", "top", "bottom")


@query(COLUMNS + " SELECT t.col, t.k::BIGINT AS k, round(sum(greatest(least(s.bottom, t.bottom) - greatest(s.top, t.top), 0) * q / (t.bottom - t.top)), 6) AS value FROM t JOIN s USING (col) GROUP BY t.col, t.k")
def vertical_remap_weighted(spark, folder):
    out = op.interpolate_vertical(_column(spark, folder, 6, 10.0), _column(spark, folder, 8, 7.0, False), ["col"])
    return out.select("col", F.col("k").cast("long").alias("k"), F.round("value", 6).alias("value"))


@query(COLUMNS + """, n AS (SELECT col, top AS p1, q AS q1, lead(top) OVER w AS p2, lead(q) OVER w AS q2, row_number() OVER w AS r FROM s WINDOW w AS (PARTITION BY col ORDER BY top))
SELECT t.col, t.k::BIGINT AS k, round(q1 + (t.top - p1) * (q2 - q1) / (p2 - p1), 6) AS value FROM t JOIN n ON t.col = n.col AND p2 IS NOT NULL AND (t.top >= p1 OR r = 1) AND (t.top < p2 OR r = 5)""")
def vertical_linear(spark, folder):
    source = _column(spark, folder, 6, 10.0).select("col", F.col("top").alias("p"), "q")
    target = _column(spark, folder, 8, 7.0, False).select("col", "k", F.col("top").alias("p"))
    out = op.linear_vertical(source, target, ["col"])
    return out.select("col", F.col("k").cast("long").alias("k"), F.round("value", 6).alias("value"))


@query("SELECT l_suppkey, l_linenumber::BIGINT AS l_linenumber, max(l_quantity) AS x FROM lineitem WHERE l_suppkey BETWEEN 3 AND 60 AND l_linenumber >= 2 GROUP BY ALL")
def array_slab(spark, folder):
    """A slab of a chunked array: the filters on both axes are met in the scan."""
    grid = lines(spark, folder).groupBy("l_suppkey", "l_linenumber").agg(F.max("l_quantity").alias("x"))
    path = f"{scratch_folder(spark)}/tidemark-array-{uuid.uuid4().hex}"
    arrays.write_array(grid, path, ["l_suppkey", "l_linenumber"], "x", [16, 4])
    return arrays.read_array(spark, path, {"l_suppkey": 3, "l_linenumber": 2}, {"l_suppkey": 58})


@query("""
WITH g AS (SELECT l_suppkey % 6 AS tile, l_suppkey // 6 AS i, l_linenumber::BIGINT AS j, max(l_quantity) AS x FROM lineitem GROUP BY ALL),
c AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY j, i) - 1 AS number FROM g WHERE (i * 3 + j) % 4 <> 0)
SELECT g.tile, g.i, g.j, number, coalesce(c.x, -1.0::DOUBLE) AS x FROM g LEFT JOIN c USING (tile, i, j)""")
def gathered_cells(spark, folder):
    """Cells under a mask written by number and expanded again, the others filled."""
    s = F.col("l_suppkey")
    grid = lines(spark, folder).groupBy((s % 6).alias("tile"), F.floor(s / 6).alias("i"), F.col("l_linenumber").cast("long").alias("j")).agg(F.max("l_quantity").alias("x"))
    path = f"{scratch_folder(spark)}/tidemark-gathered-{uuid.uuid4().hex}"
    gathering.write_gathered(grid, path, (F.col("i") * 3 + F.col("j")) % 4 != 0)
    numbers = spark.read.parquet(f"{path}/cells")
    out = gathering.read_gathered(spark, path, grid=grid.select("tile", "i", "j"), fill={"x": -1.0})
    return out.join(numbers, ["tile", "i", "j"], "left").select("tile", "i", "j", "number", "x")


@query("""
WITH g AS (SELECT l_suppkey AS i, l_linenumber::BIGINT AS j, max(l_quantity) AS x FROM lineitem GROUP BY ALL)
SELECT i, j, CASE WHEN i BETWEEN 2 AND (SELECT max(i) FROM g) - 1 AND j BETWEEN 2 AND 6 AND (i < 4 OR j > 4) THEN x ELSE 0.0::DOUBLE END AS x FROM g""")
def region_restart(spark, folder):
    """The western and northern strips of a box, two cells wide, put back into an empty field."""
    grid = lines(spark, folder).groupBy(F.col("l_suppkey").alias("i"), F.col("l_linenumber").cast("long").alias("j")).agg(F.max("l_quantity").alias("x"))
    last = grid.agg(F.max("i")).first()[0]
    path = f"{scratch_folder(spark)}/tidemark-region-{uuid.uuid4().hex}"
    gathering.save_region(grid, path, (2, last - 1, 2, 6), 2)
    return gathering.restore_region(spark, path, grid.withColumn("x", F.lit(0.0)), ["i", "j"], ("W", "N")).select("i", "j", "x")
