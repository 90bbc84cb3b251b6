"""Neighbouring cells, recurrences along columns, particles and random series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalogue.registry import query, table
from tidemark.functions.random_numbers import uniform_series
from tidemark.operators import neighbours as nb

RING = "WITH r AS (SELECT user_id, max(value) AS x FROM events GROUP BY ALL), n AS (SELECT max(user_id) + 1 AS p FROM r)"


def ring(spark, folder):
    return table(spark, folder, "events").groupBy("user_id").agg(F.max("value").alias("x"))


def _period(df):
    return df.agg(F.max("user_id") + 1).first()[0]


@query(RING + " SELECT a.user_id, a.x, b.x AS east, c.x AS west FROM r a CROSS JOIN n LEFT JOIN r b ON b.user_id = (a.user_id + 1) % p LEFT JOIN r c ON c.user_id = (a.user_id + p - 1) % p")
def halo_cyclic(spark, folder):
    df = ring(spark, folder)
    p = _period(df)
    east = nb.shifted(df, [], "user_id", 1, "x", "east", p)
    return nb.shifted(east.select("user_id", "x", "east"), [], "user_id", -1, "x", "west", p).select("user_id", "x", "east", "west")


@query(RING + " SELECT a.user_id, round(b.x + c.x - 2 * a.x, 6) AS laplacian FROM r a CROSS JOIN n JOIN r b ON b.user_id = (a.user_id + 1) % p JOIN r c ON c.user_id = (a.user_id + p - 1) % p")
def laplacian_neighbors(spark, folder):
    df = halo_cyclic(spark, folder).where("east is not null and west is not null")
    return df.select("user_id", F.round(F.col("east") + F.col("west") - 2 * F.col("x"), 6).alias("laplacian"))


@query("""
WITH g AS (SELECT l_suppkey AS j, l_linenumber AS i, max(l_extendedprice) AS x FROM lineitem GROUP BY ALL)
SELECT j, i, round(CASE WHEN lag(x) OVER w IS NULL THEN (lead(x) OVER w - x) / 2 WHEN lead(x) OVER w IS NULL THEN (x - lag(x) OVER w) / 2 ELSE (lead(x) OVER w - lag(x) OVER w) / 4 END, 6) AS gradient
FROM g WINDOW w AS (PARTITION BY j ORDER BY i)""")
def gradient_zonal(spark, folder):
    df = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("j"), F.col("l_linenumber").alias("i")).agg(F.max("l_extendedprice").alias("x"))
    return df.select("j", "i", F.round(nb.centred_gradient(["j"], "i", "x", 2.0), 6).alias("gradient"))


@query("""
WITH g AS (SELECT l_suppkey AS j, l_linenumber AS i, min(l_quantity) AS x FROM lineitem GROUP BY ALL), s AS (SELECT j, x - lag(x) OVER (PARTITION BY j ORDER BY i) AS d FROM g)
SELECT j, bool_and(coalesce(d > 0, true)) OR bool_and(coalesce(d < 0, true)) AS monotonic FROM s GROUP BY j""")
def monotonic(spark, folder):
    df = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("j"), F.col("l_linenumber").alias("i")).agg(F.min("l_quantity").alias("x"))
    return nb.is_monotonic(df, ["j"], "i", "x")


@query("SELECT l_linenumber, l_suppkey // 4 AS i, round(avg(l_quantity), 6) AS x, count(*) AS n FROM lineitem GROUP BY ALL")
def nest_coarse(spark, folder):
    df = table(spark, folder, "lineitem").select("l_linenumber", F.col("l_suppkey").alias("i"), F.col("l_quantity").alias("x"))
    out = nb.coarsen(df, ["l_linenumber"], ["i"], 4, "x")
    return out.select("l_linenumber", "i", F.round("x", 6).alias("x"), "n")


@query("WITH c AS (SELECT l_suppkey // 4 AS i, max(l_quantity) AS x FROM lineitem GROUP BY ALL) SELECT s_suppkey, x FROM supplier LEFT JOIN c ON i = s_suppkey // 4")
def nest_fine(spark, folder):
    coarse = nb.coarsen(table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("i"), F.col("l_quantity").alias("x")), [], ["i"], 4, "x", "max")
    fine = table(spark, folder, "supplier").select("s_suppkey", F.col("s_suppkey").alias("i"))
    return nb.refine(coarse, fine, [], ["i"], 4, "x").select("s_suppkey", "x")


@query("""
WITH RECURSIVE c AS (SELECT user_id % 15 AS i, user_id // 15 AS j, max(value) AS x FROM events GROUP BY ALL), q AS (SELECT quantile_disc(x, 0.4) AS crit, quantile_disc(x, 0.97) AS seed FROM c),
f AS (SELECT i, j FROM c, q WHERE x > seed UNION SELECT c.i, c.j FROM f, c, q WHERE c.x > crit AND abs(c.j - f.j) <= 1 AND least(abs(c.i - f.i), 15 - abs(c.i - f.i)) <= 1)
SELECT i, j FROM f""")
def flood_fill(spark, folder):
    df = table(spark, folder, "events").groupBy((F.col("user_id") % 15).alias("i"), F.floor(F.col("user_id") / 15).alias("j")).agg(F.max("value").alias("x"))
    critical, seed = df.selectExpr("percentile_disc(0.4) WITHIN GROUP (ORDER BY x) AS a", "percentile_disc(0.97) WITHIN GROUP (ORDER BY x) AS b").first()
    return nb.flood_fill(df, "i", "j", "x", seed, critical, period=15)


def _spline_sql(first: str, last: str) -> str:
    """The tridiagonal system of second derivatives swept down and up; ``first`` and ``last`` are the end rows."""
    return f"""
WITH RECURSIVE g AS (SELECT p_brand, p_size::DOUBLE AS x, max(p_retailprice) AS y FROM part GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY p_brand) AS last, x - lag(x) OVER w AS h0, lead(x) OVER w - x AS h1, (y - lag(y) OVER w) / (x - lag(x) OVER w) AS d0, (lead(y) OVER w - y) / (lead(x) OVER w - x) AS d1
  FROM g WINDOW w AS (PARTITION BY p_brand ORDER BY x)),
m AS (SELECT p_brand, n, last, x, y, u.a, u.b, u.c, u.r FROM (SELECT *, CASE WHEN n = 1 THEN {first} WHEN n = last THEN {last} ELSE {{'a': h0 / 6, 'b': (h0 + h1) / 3, 'c': h1 / 6, 'r': d1 - d0}} END AS u FROM r)),
down(p_brand, n, e, f) AS (SELECT p_brand, n, c / b, r / b FROM m WHERE n = 1
 UNION ALL SELECT m.p_brand, m.n, c / (b - a * e), (r - a * f) / (b - a * e) FROM down JOIN m ON m.p_brand = down.p_brand AND m.n = down.n + 1),
up(p_brand, n, s) AS (SELECT p_brand, n, f FROM down JOIN m USING (p_brand, n) WHERE n = last
 UNION ALL SELECT down.p_brand, down.n, f - e * s FROM up JOIN down ON down.p_brand = up.p_brand AND down.n = up.n - 1),
t AS (SELECT DISTINCT p_brand, p_size * 0.5::DOUBLE + 1 AS at_x FROM part),
k AS (SELECT p_brand, at_x, least(greatest(count_if(x <= at_x), 1), any_value(last) - 1) AS n FROM t JOIN m USING (p_brand) GROUP BY ALL),
v AS (SELECT k.p_brand, at_x, (o.x - at_x) / (o.x - i.x) AS p, (at_x - i.x) / (o.x - i.x) AS q, o.x - i.x AS h, i.y AS y1, o.y AS y2, u1.s AS s1, u2.s AS s2
  FROM k JOIN m i ON i.p_brand = k.p_brand AND i.n = k.n JOIN m o ON o.p_brand = k.p_brand AND o.n = k.n + 1 JOIN up u1 ON u1.p_brand = k.p_brand AND u1.n = k.n JOIN up u2 ON u2.p_brand = k.p_brand AND u2.n = k.n + 1)
SELECT p_brand, at_x AS "at", round(p * y1 + q * y2 + ((p ** 3 - p) * s1 + (q ** 3 - q) * s2) * h * h / 6, 6) AS value FROM v"""


def _splined(spark, folder, slopes=(None, None)):
    df = table(spark, folder, "part").groupBy("p_brand", F.col("p_size").alias("s")).agg(F.max("p_retailprice").alias("y"))
    targets = table(spark, folder, "part").select("p_brand", (F.col("p_size") * 0.5 + 1).alias("at")).distinct()
    return nb.spline(df.select("p_brand", F.col("s").cast("double").alias("x"), "y"), targets, ["p_brand"], slopes).select("p_brand", "at", F.round("value", 6).alias("value"))


_FREE = "{'a': 0.0::DOUBLE, 'b': 1.0::DOUBLE, 'c': 0.0::DOUBLE, 'r': 0.0::DOUBLE}"


@query(_spline_sql(_FREE, _FREE))
def spline_1d(spark, folder):
    return _splined(spark, folder)


@query(_spline_sql("{'a': 0.0::DOUBLE, 'b': h1 / 3, 'c': h1 / 6, 'r': d1 - 2}", "{'a': h0 / 6, 'b': h0 / 3, 'c': 0.0::DOUBLE, 'r': -1 - d0}"))
def spline_clamped(spark, folder):
    """Slopes of 2 and -1 at the ends."""
    return _splined(spark, folder, (2.0, -1.0))


@query("""
WITH RECURSIVE g AS (SELECT l_suppkey, l_linenumber AS k, max(l_quantity) AS d FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY k) AS n, count(*) OVER (PARTITION BY l_suppkey) AS last FROM g),
down(l_suppkey, n, e, f) AS (SELECT l_suppkey, n, 1 / 4.0::DOUBLE, d / 4.0::DOUBLE FROM r WHERE n = 1
 UNION ALL SELECT r.l_suppkey, r.n, 1 / (4 - e), (d - f) / (4 - e) FROM down JOIN r ON r.l_suppkey = down.l_suppkey AND r.n = down.n + 1),
up(l_suppkey, n, x) AS (SELECT l_suppkey, n, f FROM down JOIN r USING (l_suppkey, n) WHERE n = last
 UNION ALL SELECT down.l_suppkey, down.n, f - e * x FROM up JOIN down ON down.l_suppkey = up.l_suppkey AND down.n = up.n - 1)
SELECT l_suppkey, k, round(x, 9) AS x FROM up JOIN r USING (l_suppkey, n)""")
def tridiag_solve(spark, folder):
    df = table(spark, folder, "lineitem").groupBy("l_suppkey", F.col("l_linenumber").alias("k")).agg(F.max("l_quantity").alias("d"))
    df = df.select("l_suppkey", "k", F.lit(1.0).alias("a"), F.lit(4.0).alias("b"), F.lit(1.0).alias("c"), "d")
    return nb.tridiagonal(df, ["l_suppkey"]).select("l_suppkey", "k", F.round("x", 9).alias("x"))


@query()
def rk4_drifters(spark, folder):
    """Particles in a rotating flow on a 20 x 20 grid, four steps."""
    cell = F.col("id")
    velocity = spark.range(400).select(cell.alias("cell"), (-(cell % 20 - 9.5)).alias("u"), (F.floor(cell / 20) - 9.5).alias("v"))
    at = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), (5 + F.col("c_custkey") % 100 / 10.0).alias("x"), (5 + F.col("c_custkey") % 77 / 8.0).alias("y"))
    at = nb.push(at, [("x", "u"), ("y", "v")], [20, 20], velocity, 0.1)
    return at.select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query()
def mersenne_uniform(spark, folder):
    return uniform_series(table(spark, folder, "supplier"), "s_suppkey", "s_suppkey", 5)
