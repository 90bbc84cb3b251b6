"""Solar angles, surface-layer profiles, surface climatologies, gaps and grid tests."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.catalogue.registry import query, table
from tidemark.functions import calendar as cal
from tidemark.functions import physics as ph
from tidemark.operators import fields
from tidemark.operators import neighbours as nb
from tidemark.operators import regrid

SUN = """WITH a AS (SELECT event_id, radians(user_id % 179 - 89) AS lat, radians(user_id * 7 % 360) AS lon, (epoch_us(ts) // 1000000 % 86400) * 2 * pi() / 86400 AS gmt,
 radians(event_id % 360) AS ang FROM events),
d AS (SELECT *, asin(-sin(radians(23.439)) * sin(ang)) AS dec, gmt + lon - 2 * pi() * floor((gmt + lon) / (2 * pi())) - pi() AS t FROM a),
h AS (SELECT *, sin(lat) * sin(dec) AS a, cos(lat) * cos(dec) AS b, CASE WHEN -tan(lat) * tan(dec) >= 1 THEN 0 WHEN -tan(lat) * tan(dec) <= -1 THEN pi() ELSE acos(-tan(lat) * tan(dec)) END AS h FROM d)"""


def _sun(spark, folder):
    second = F.pmod(F.expr("unix_micros(cast(ts as timestamp)) div 1000000"), F.lit(86400))
    return table(spark, folder, "events").select(
        "event_id", F.radians(F.col("user_id") % 179 - 89).alias("lat"), F.radians(F.col("user_id") * 7 % 360).alias("lon"),
        (second * 2 * math.pi / 86400).alias("gmt"), F.radians(F.col("event_id") % 360).alias("ang"),
    )


@query(SUN + " SELECT event_id, round(CASE WHEN abs(t) < h THEN greatest(0, a + b * cos(t)) ELSE 0 END, 8) AS cosz, CASE WHEN abs(t) < h THEN 1.0 ELSE 0.0 END::DOUBLE AS fracday FROM h")
def diurnal_solar(spark, folder):
    cosz, light = ph.diurnal_solar(*[F.col(c) for c in ("lat", "lon", "gmt", "ang")])
    return _sun(spark, folder).select("event_id", F.round(cosz, 8).alias("cosz"), light.alias("fracday"))


@query(SUN + """, s AS (SELECT event_id, a, b, n, greatest(t, n - h) AS lo, least(t + pi() / 2, n + h) AS hi FROM h, (VALUES (0.0), (2 * pi())) AS noons(n)),
m AS (SELECT event_id, sum(hi - lo) FILTER (WHERE hi > lo) AS light, sum(a * (hi - lo) + b * (sin(hi) - sin(lo))) FILTER (WHERE hi > lo) AS area FROM s GROUP BY ALL)
SELECT event_id, round(coalesce(greatest(0, area / light), 0), 6) AS cosz, round(coalesce(light, 0) / (pi() / 2), 6) AS fracday FROM m""")
def diurnal_solar_mean(spark, folder):
    """Over six hours from each event."""
    cosz, light = ph.diurnal_solar(*[F.col(c) for c in ("lat", "lon", "gmt", "ang")], dt=F.lit(math.pi / 2))
    return _sun(spark, folder).select("event_id", F.round(cosz, 6).alias("cosz"), F.round(light, 6).alias("fracday"))


def _integral(rough: float) -> str:
    """Of phi / z up to 30 m, over unstable air or stable air."""
    x, x0 = "pow(1 - 16 * least(zeta, 0), 0.25)", f"pow(1 - 16 * least(zeta * {rough} / 30, 0), 0.25)"
    loss = f"ln((1 + {x} * {x}) * pow(1 + {x}, 2) / ((1 + {x0} * {x0}) * pow(1 + {x0}, 2)))"
    return f"""(ln(30 / {rough}::DOUBLE) + CASE WHEN zeta < 0 THEN 2 * (atan({x}) - atan({x0})) - {loss}
 ELSE 4.5 * ln((1 + zeta) / (1 + zeta * {rough} / 30)) + 0.5 * (zeta - zeta * {rough} / 30) END)"""


MO = f"""WITH a AS (SELECT l_orderkey, l_linenumber, -0.4 * (l_quantity - 20) / 1000 * 30 / 0.09::DOUBLE AS zeta FROM lineitem)
SELECT l_orderkey, l_linenumber, round(1 - {_integral(10.0)} / {_integral(0.05)}, 7) AS wind FROM a"""


@query(MO)
def surface_profile(spark, folder):
    b_star = (F.col("l_quantity") - 20) / 1000
    wind, _ = ph.wind_and_scalar_shares(*[F.lit(x) for x in (30.0, 10.0, 2.0, 0.05, 0.01, 0.3)], b_star)
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.round(wind, 7).alias("wind"))


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, 0.4 * 0.3 * 5.0 * l_linenumber::DOUBLE AS k, -0.4 * (l_quantity - 20) / 10000 * 5 * l_linenumber / 0.09::DOUBLE AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, round(k / CASE WHEN x < 0 THEN pow(1 - 16 * x, -0.25) ELSE 1 + x * (5 + x / 2) / (1 + x) END, 7) AS momentum,
 round(k / CASE WHEN x < 0 THEN pow(1 - 16 * x, -0.5) ELSE 1 + x * (5 + x / 2) / (1 + x) END, 7) AS heat FROM a""")
def surface_diffusivity(spark, folder):
    momentum, heat = ph.diffusivity(F.col("l_linenumber") * 5.0, F.lit(0.3), (F.col("l_quantity") - 20) / 10000)
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.round(momentum, 7).alias("momentum"), F.round(heat, 7).alias("heat"))


W = "pow(10, -7.90298 * (373.16 / u - 1) + 5.02808 * log10(373.16 / u) - 1.3816e-7 * (pow(10, 11.344 * (1 - u / 373.16)) - 1) + 8.1328e-3 * (pow(10, -3.49149 * (373.16 / u - 1)) - 1) + log10(101324.60))"


@query(f"""WITH a AS (SELECT p_partkey, (274 + p_size)::DOUBLE AS t FROM part), u AS (SELECT *, unnest([t - 0.01, t + 0.01]) AS u FROM a), e AS (SELECT p_partkey, t, u, {W} AS e FROM u)
SELECT p_partkey, round((max(e) - min(e)) / 0.02, 3) AS slope FROM e GROUP BY p_partkey""")
def sat_es_slope(spark, folder):
    t = (F.lit(274) + F.col("p_size")).cast("double")
    return table(spark, folder, "part").select("p_partkey", F.round(ph.es_slope(t), 3).alias("slope"))


@query("""SELECT l_linenumber, count(*) FILTER (WHERE t < 113.16 OR t > 373.16) AS bad, min(t) AS low, max(t) AS high
FROM (SELECT l_linenumber, 100 + l_quantity * 6 AS t FROM lineitem) GROUP BY l_linenumber""")
def temperature_report(spark, folder):
    return ph.temperature_report(table(spark, folder, "lineitem").select("l_linenumber", (100 + F.col("l_quantity") * 6).alias("t")), ["l_linenumber"], "t")


@query("""WITH a AS (SELECT o_orderkey, radians(o_custkey % 179 - 89) AS lat, (dayofyear(o_orderdate) - 1) / (365 + (CASE WHEN year(o_orderdate) % 4 = 0 THEN 1 ELSE 0 END))::DOUBLE AS f FROM orders),
s AS (SELECT o_orderkey, 305 - 50 * sin(lat) * sin(lat) - sin(2 * pi() * (f - 0.875)) * 20 * sin(lat) AS s FROM a)
SELECT o_orderkey, round(greatest(s, 271.38), 7) AS sst, CASE WHEN s < 271.38 THEN 1.0 ELSE 0.0 END::DOUBLE AS ice FROM s""")
def zonal_sst(spark, folder):
    d = F.col("o_orderdate")
    part = cal.year_fraction(cal.set_date(F.year(d), F.month(d), F.dayofmonth(d), "gregorian"), "gregorian")
    sst = ph.zonal_temperature(F.radians(F.col("o_custkey") % 179 - 89), part, 305.0, 50.0, 20.0, 0.875)
    ice = F.when(sst < ph.ICE_CRITICAL, 1.0).otherwise(0.0)
    return table(spark, folder, "orders").select("o_orderkey", F.round(ph.clip_surface(sst, "sst"), 7).alias("sst"), ice.alias("ice"))


def _pass(old: str, new: str) -> str:
    """One pass over blanks of ``old``: neighbours' mean unless the only one sits in a corner."""
    return f"""{new} AS (SELECT a.i, a.j, CASE WHEN a.x IS NOT NULL THEN any_value(a.x)
 WHEN count(b.x) > 1 OR max(CASE WHEN NOT (b.i IN (greatest(a.i - 1, 0), least(a.i + 1, 14)) AND b.j IN (greatest(a.j - 1, 0), least(a.j + 1, 9))) THEN 1 END) = 1 THEN avg(b.x) END AS x
 FROM {old} a LEFT JOIN {old} b ON a.x IS NULL AND b.x IS NOT NULL AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 GROUP BY a.i, a.j, a.x)"""


@query(f"""WITH g AS (SELECT user_id % 15 AS i, user_id // 15 AS j, max(value) AS m FROM events GROUP BY ALL), f0 AS (SELECT i, j, CASE WHEN (i * 7 + j * 3) % 11 < 3 THEN m END AS x FROM g),
{_pass("f0", "f1")}, {_pass("f1", "f2")} SELECT i, j, round(x, 6) AS x FROM f2""")
def gap_fill(spark, folder):
    df = table(spark, folder, "events").groupBy((F.col("user_id") % 15).alias("i"), F.floor(F.col("user_id") / 15).alias("j")).agg(F.max("value").alias("x"))
    holes = df.withColumn("x", F.when((F.col("i") * 7 + F.col("j") * 3) % 11 < 3, F.col("x")))
    return nb.fill_gaps(holes, [], "i", "j", "x", ((0, 14), (0, 9)), passes=2).select("i", "j", F.round("x", 6).alias("x"))


@query("SELECT o_custkey, o_orderkey AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS o_orderkey FROM orders")
def permutation_inverse(spark, folder):
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    df = table(spark, folder, "orders").select("o_custkey", "o_orderkey", rank.alias("r"))
    return nb.inverse_permutation(df, ["o_custkey"], "r", "o_orderkey").select("o_custkey", "r", "o_orderkey")


@query("""WITH c AS (SELECT l_suppkey, l_linenumber % 3 AS i, l_linenumber // 3 AS j, CASE WHEN l_suppkey % 2 = 0 THEN l_linenumber % 3 ELSE l_linenumber END AS lon, l_linenumber // 3 AS lat FROM lineitem),
o AS (SELECT l_suppkey, min(lat) = max(lat) AS one FROM c GROUP BY l_suppkey, j UNION ALL SELECT l_suppkey, min(lon) = max(lon) FROM c GROUP BY l_suppkey, i)
SELECT l_suppkey, bool_and(one) AS separable FROM o GROUP BY l_suppkey""")
def grid_separable(spark, folder):
    n = F.col("l_linenumber")
    i, j = n % 3, F.floor(n / 3)
    cells = table(spark, folder, "lineitem").select("l_suppkey", i.alias("i"), j.alias("j"), F.when(F.col("l_suppkey") % 2 == 0, i).otherwise(n).alias("lon"), j.alias("lat"))
    return regrid.is_separable(cells, ["l_suppkey"])


@query("SELECT l_orderkey, round(sum(l_quantity * (100 + l_linenumber) / 9.8), 6) AS burden FROM lineitem GROUP BY l_orderkey")
def column_burden(spark, folder):
    n = F.col("l_linenumber")
    layers = table(spark, folder, "lineitem").select("l_orderkey", (n * 100.0).alias("top"), (n * 101.0 + 100).alias("bottom"), F.col("l_quantity").alias("q"))
    return fields.column_burden(layers, ["l_orderkey"]).select("l_orderkey", F.round("burden", 6).alias("burden"))
