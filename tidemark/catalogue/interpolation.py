"""As-of interpolation and regridding over the driver's tables."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from tidemark.catalogue.registry import query, table
from tidemark.operators import asof, regrid
from tidemark.operators.climatology import climatology
from tidemark.operators.windows import SECOND, micros

HOUR = 3600 * SECOND
DAY = 24 * HOUR


def _events(spark, folder):
    return table(spark, folder, "events").withColumn("t", micros(F.col("ts")))


@query("""
WITH r AS (SELECT user_id, epoch_us(ts) AS t, value FROM events WHERE event_type = 'view'), l AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'purchase'),
a AS (SELECT l.*, r.t AS t1, r.value AS x1 FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.t >= r.t),
b AS (SELECT a.*, r.t AS t2, r.value AS x2 FROM a ASOF LEFT JOIN r ON a.user_id = r.user_id AND a.t <= r.t)
SELECT event_id, CASE WHEN t1 = t2 THEN round(x1, 6) ELSE round((1 - (t - t1) / (t2 - t1)) * x1 + (t - t1) / (t2 - t1) * x2, 6) END AS value FROM b""")
def asof_linear(spark, folder):
    df = _events(spark, folder)
    left = df.where("event_type = 'purchase'").select("event_id", "user_id", "t")
    right = df.where("event_type = 'view'").select("user_id", "t", "value")
    out = asof.asof_linear(left, right, ["user_id"], "t", "value")
    return out.select("event_id", F.round("interpolated", 6).alias("value"))


CLIMATE = """WITH c AS (SELECT (l_linenumber - 1) * 4.0 AS h, sum(l_quantity::DECIMAL(18,2))::DOUBLE / count(*) AS x FROM lineitem WHERE l_linenumber <= 6 GROUP BY ALL),
s AS (SELECT h AS t1, x AS x1, lead(h) OVER (ORDER BY h) AS t2, lead(x) OVER (ORDER BY h) AS x2 FROM c)"""


def _climate(spark, folder):
    df = table(spark, folder, "lineitem").where("l_linenumber <= 6").groupBy("l_linenumber")
    df = df.agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("s"), F.count("*").alias("n"))
    return df.select(((F.col("l_linenumber") - 1) * 4.0).alias("h"), (F.col("s") / F.col("n")).alias("x"))


@query(CLIMATE + """, w AS (SELECT t1, x1, t2, x2 FROM s WHERE t2 IS NOT NULL UNION ALL SELECT 20.0, (SELECT x FROM c WHERE h = 20), 24.0, (SELECT x FROM c WHERE h = 0))
SELECT event_id, round((1 - (hour - t1) / (t2 - t1)) * x1 + (hour - t1) / (t2 - t1) * x2, 6) AS value
FROM (SELECT event_id, (epoch_us(ts) % 86400000000) / 3600000000.0::DOUBLE AS hour FROM events) e JOIN w ON hour >= t1 AND hour < t2""")
def asof_modulo_day(spark, folder):
    spans = asof.intervals(_climate(spark, folder), "h", "x", period=24)
    hour = F.pmod(F.col("t"), F.lit(DAY)) / F.lit(float(HOUR))
    out = asof.interpolate_list(_events(spark, folder), spans, hour)
    return out.select("event_id", F.round("interpolated", 6).alias("value"))


@query("""
WITH m AS (SELECT event_id, day(ts) - 1 + (epoch_us(ts) % 86400000000) / 86400000000.0::DOUBLE AS cur, day(last_day(ts)) / 2.0::DOUBLE AS half,
  CASE WHEN day(ts) - 1 + (epoch_us(ts) % 86400000000) / 86400000000.0::DOUBLE >= day(last_day(ts)) / 2.0::DOUBLE
       THEN day(last_day(ts + INTERVAL 1 MONTH)) / 2.0::DOUBLE ELSE day(last_day(ts - INTERVAL 1 MONTH)) / 2.0::DOUBLE END AS other FROM events)
SELECT event_id, cur >= half AS later, round(CASE WHEN cur >= half THEN (cur - half) / (half + other) ELSE (cur + other) / (half + other) END, 6) AS weight FROM m""")
def asof_midmonth(spark, folder):
    df = _events(spark, folder)
    cur = F.dayofmonth("ts") - 1 + F.pmod(F.col("t"), F.lit(DAY)) / F.lit(float(DAY))
    half = F.dayofmonth(F.last_day("ts")) / 2.0
    following = F.dayofmonth(F.last_day(F.add_months("ts", 1))) / 2.0
    preceding = F.dayofmonth(F.last_day(F.add_months("ts", -1))) / 2.0
    weight, later = asof.mid_weight(cur, half, F.when(cur >= half, following).otherwise(preceding))
    return df.select("event_id", later.alias("later"), F.round(weight, 6).alias("weight"))


@query("""
WITH e AS (SELECT event_id, epoch_us(ts) AS t, value FROM events), now AS (SELECT * FROM e WHERE t BETWEEN 1704844800000000 AND 1705708800000000)
SELECT event_id, value FROM now UNION ALL SELECT event_id, value FROM e WHERE event_id % 2 = 0 AND t < (SELECT min(t) FROM now)
UNION ALL SELECT event_id, value FROM e WHERE event_id % 2 = 1 AND t > (SELECT max(t) FROM now)""")
def asof_bridge(spark, folder):
    df = _events(spark, folder).select("event_id", "t", "value")
    now = df.where(F.col("t").between(1_704_844_800_000_000, 1_705_708_800_000_000))
    return asof.bridge(df.where("event_id % 2 = 0"), now, df.where("event_id % 2 = 1"), "t").select("event_id", "value")


AXIS = [1.0, 5.0, 12.0, 20.0, 33.0, 47.0]


@query("""
SELECT p_partkey, 1 + (p_size >= 3)::INT + (p_size >= 8.5)::INT + (p_size >= 16)::INT + (p_size >= 26.5)::INT + (p_size >= 40)::INT AS i FROM part""")
def nearest_index(spark, folder):
    return table(spark, folder, "part").select("p_partkey", asof.nearest_index(F.col("p_size"), AXIS).alias("i"))


@query("""
WITH a(i, lo, hi) AS (VALUES (1, 1, 5), (2, 5, 12), (3, 12, 20), (4, 20, 33), (5, 33, 47)),
m AS (SELECT p_partkey, min(i + (p_size - lo) / (hi - lo)::DOUBLE) AS f FROM part JOIN a ON p_size BETWEEN lo AND hi GROUP BY ALL)
SELECT p_partkey, round(coalesce(f, -1), 8) AS f FROM part LEFT JOIN m USING (p_partkey)""")
def frac_index(spark, folder):
    return table(spark, folder, "part").select("p_partkey", F.round(asof.fractional_index(F.col("p_size"), AXIS), 8).alias("f"))


@query("""
WITH f AS (SELECT l_suppkey % 36 AS src, sum(l_quantity::DECIMAL(18,2))::DOUBLE / count(*) AS x FROM lineitem WHERE l_suppkey % 36 NOT BETWEEN 8 AND 12 GROUP BY ALL),
s AS (SELECT i AS src, i * 10.0 AS lo, i * 10.0 + 10 AS hi FROM range(36) t(i)), d AS (SELECT i AS dst, i * 7.0 AS lo, i * 7.0 + 7 AS hi FROM range(54) t(i)),
o AS (SELECT src, dst, least(s.hi, d.hi) - greatest(s.lo, d.lo) AS w FROM s JOIN d ON s.lo < d.hi AND d.lo < s.hi)
SELECT dst, round(coalesce(sum(x * w) / sum(w) FILTER (x IS NOT NULL), 0), 6) AS value, round(coalesce(coalesce(sum(w) FILTER (x IS NOT NULL), 0) / sum(w), 0), 6) AS mask_out FROM d LEFT JOIN o USING (dst) LEFT JOIN f USING (src) GROUP BY dst""")
def overlap_conserve(spark, folder):
    """Sources 8 to 12 are missing and the last two targets begin beyond all sources: value 0 and mask 0."""
    field = table(spark, folder, "lineitem").where("l_suppkey % 36 not between 8 and 12").groupBy((F.col("l_suppkey") % 36).alias("src"))
    field = field.agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("s"), F.count("*").alias("n")).select("src", (F.col("s") / F.col("n")).alias("x"))
    edges = lambda name, n, w: spark.range(n).select(F.col("id").alias(name), (F.col("id") * w).alias("lo"), (F.col("id") * w + w).alias("hi"))
    source = edges("src", 36, 10.0)
    field = source.select("src").join(field, "src", "left")
    out = regrid.conserve(field, source, edges("dst", 54, 7.0), "x", 20.0)
    return out.select("dst", F.round("value", 6).alias("value"), F.round("mask_out", 6).alias("mask_out"))


@query("""
WITH f AS (SELECT l_suppkey % 36 AS src, sum(l_quantity::DECIMAL(18,2))::DOUBLE / count(*) AS x FROM lineitem GROUP BY ALL),
s AS (SELECT i AS src, i * 10.0 + 355 AS lo, i * 10.0 + 365 AS hi FROM range(36) t(i)), d AS (SELECT i AS dst, i * 24.0 - 190 AS lo, i * 24.0 - 166 AS hi FROM range(15) t(i)),
o AS (SELECT src, dst, sum(least(s.hi + 360 * k, d.hi) - greatest(s.lo + 360 * k, d.lo)) AS w FROM s, d, range(-4, 4) t(k) WHERE s.lo + 360 * k < d.hi AND d.lo < s.hi + 360 * k GROUP BY ALL)
SELECT dst, round(sum(x * w) / sum(w), 6) AS value, round(sum(w), 6) AS width FROM o JOIN f USING (src) GROUP BY dst""")
def overlap_periodic(spark, folder):
    """Cells from 355 degrees on against cells from -190: the same circle, cut elsewhere."""
    field = table(spark, folder, "lineitem").groupBy((F.col("l_suppkey") % 36).alias("src"))
    field = field.agg((F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double") / F.count("*")).alias("x"))
    source = spark.range(36).select(F.col("id").alias("src"), (F.col("id") * 10.0 + 355).alias("lo"), (F.col("id") * 10.0 + 365).alias("hi"))
    target = spark.range(15).select(F.col("id").alias("dst"), (F.col("id") * 24.0 - 190).alias("lo"), (F.col("id") * 24.0 - 166).alias("hi"))
    width = regrid.overlaps(source, target, 24.0, 360.0).join(field.select("src"), "src").groupBy("dst").agg(F.sum("w").alias("width"))
    out = regrid.conserve(field, source, target, "x", 24.0, period=360.0).join(width, "dst")
    return out.select("dst", F.round("value", 6).alias("value"), F.round("width", 6).alias("width"))


BOXES = """
WITH f AS (SELECT l_suppkey % 36 AS i, l_linenumber - 1 AS j, sum(l_quantity::DECIMAL(18,2))::DOUBLE / count(*) - 25 AS x FROM lineitem GROUP BY ALL),
s AS (SELECT i, j, i * 10.0 AS a, i * 10.0 + 10 AS b, j * 20.0 - 70 AS c, j * 20.0 - 50 AS d FROM range(36) t(i), range(7) u(j)),
t AS (SELECT p * 10 + q AS dst, p * 30.0 - 15 AS a, p * 30.0 + 15 AS b, q * 25.0 - 75 AS c, least(q * 25.0 - 50, 90) AS d FROM range(12) t(p), range(7) u(q)),
o AS (SELECT dst, s.i, s.j, sum(radians(least(s.b + 360 * k, t.b) - greatest(s.a + 360 * k, t.a)) * (sin(radians(least(s.d, t.d))) - sin(radians(greatest(s.c, t.c))))) AS w
  FROM s, t, range(-1, 2) r(k) WHERE s.a + 360 * k < t.b AND t.a < s.b + 360 * k AND s.c < t.d AND t.c < s.d GROUP BY ALL)"""


def _boxes(spark):
    n = F.col("id")
    i, j = n % 36, F.floor(n / 36)
    source = spark.range(252).select((i * 100 + j).alias("src"), (i * 10.0).alias("lon0"), (i * 10.0 + 10).alias("lon1"), (j * 20.0 - 70).alias("lat0"), (j * 20.0 - 50).alias("lat1"))
    p, q = n % 12, F.floor(n / 12)
    north = F.least(q * 25.0 - 50, F.lit(90.0))
    target = spark.range(84).select((p * 10 + q).alias("dst"), (p * 30.0 - 15).alias("lon0"), (p * 30.0 + 15).alias("lon1"), (q * 25.0 - 75).alias("lat0"), north.alias("lat1"))
    return regrid.box_overlaps(source, target, (30.0, 25.0)), target


def _box_field(spark, folder):
    df = table(spark, folder, "lineitem").groupBy(((F.col("l_suppkey") % 36) * 100 + F.col("l_linenumber") - 1).alias("src"))
    return df.agg((F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double") / F.count("*") - 25).alias("x"))


@query(BOXES + """ SELECT dst, round(coalesce(sum(x * w) / sum(w) FILTER (x IS NOT NULL), 0), 6) AS value, round(coalesce(coalesce(sum(w) FILTER (x IS NOT NULL), 0) / sum(w), 0), 6) AS mask_out
FROM t LEFT JOIN o USING (dst) LEFT JOIN f USING (i, j) GROUP BY dst""")
def conserve_boxes(spark, folder):
    """Targets from 75 degrees on have no source, those across 70 degrees a part of one."""
    overlap, target = _boxes(spark)
    out = regrid.conserve_boxes(_box_field(spark, folder), overlap, "x", target=target)
    return out.select("dst", F.round("value", 6).alias("value"), F.round("mask_out", 6).alias("mask_out"))


@query(BOXES + """ SELECT dst, round(sum(x * w) / sum(w), 6) AS mean, round(sum(CASE WHEN x < 0 THEN w ELSE 0 END) / sum(w), 6) AS ocean_frac,
  round(sqrt(greatest(0, sum(x * x * w) / sum(w) - pow(sum(x * w) / sum(w), 2))), 4) AS deviation FROM o JOIN f USING (i, j) GROUP BY dst""")
def land_fraction(spark, folder):
    out = regrid.land_fraction(_box_field(spark, folder), _boxes(spark)[0], "x")
    return out.select("dst", F.round("mean", 6).alias("mean"), F.round("ocean_frac", 6).alias("ocean_frac"), F.round("deviation", 4).alias("deviation"))


@query("""
WITH r AS (SELECT extract(year FROM o_orderdate) AS y, o_orderkey, o_orderdate AS t FROM orders),
m AS (SELECT o_orderkey, t, (t + to_years((1996 + (y - 1996 + 300) % 3 - y)::INT))::TIMESTAMP AS u FROM r)
SELECT o_orderkey, CASE WHEN u < TIMESTAMP '1996-03-15 06:00:00' THEN (t + to_years((1999 - year(t))::INT))::TIMESTAMP ELSE u END AS moved,
  788918400 + (epoch_us(t) // 1000000 - 788918400 + 86400000::BIGINT * 1000) % 86400000 AS plain FROM m""")
def asof_loop(spark, folder):
    """Dates moved into a loop of three years with the leap-year correction, and into a plain loop of a thousand days."""
    df = table(spark, folder, "orders")
    moved = asof.loop_date(F.col("o_orderdate"), "1996-03-15 06:00:00", "1999-03-15 06:00:00")
    seconds = F.floor(micros(F.col("o_orderdate")) / SECOND)
    return df.select("o_orderkey", moved.alias("moved"), asof.loop_time(seconds, 788_918_400, 788_918_400 + 86_400_000).cast("long").alias("plain"))


FIELD = "WITH f AS (SELECT l_suppkey % 10 AS i, l_linenumber - 1 AS j, sum(l_quantity::DECIMAL(18,2))::DOUBLE / count(*) AS x FROM lineitem GROUP BY ALL)"


def _field(spark, folder):
    df = table(spark, folder, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("i"), (F.col("l_linenumber") - 1).alias("j"))
    df = df.agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("s"), F.count("*").alias("n"))
    return df.select("i", "j", (F.col("s") / F.col("n")).alias("x"))


@query(FIELD + """, w AS (SELECT d.i AS dst, i.i AS i, j.j AS j, 1.0 + (d.i * 7 + i.i * 3 + j.j) % 5 AS w FROM range(8) d(i), range(10) i(i), range(7) j(j) WHERE (d.i + i.i + j.j) % 3 = 0)
SELECT dst, round(sum(x * w) / sum(w), 6) AS value FROM w JOIN f USING (i, j) GROUP BY dst""")
def regrid_spmv(spark, folder):
    w = spark.range(8 * 10 * 7).select((F.col("id") % 8).alias("dst"), (F.floor(F.col("id") / 8) % 10).alias("i"), F.floor(F.col("id") / 80).alias("j"))
    w = w.where("(dst + i + j) % 3 = 0").withColumn("w", 1.0 + (F.col("dst") * 7 + F.col("i") * 3 + F.col("j")) % 5)
    out = regrid.apply_weights(_field(spark, folder), w, ["i", "j"], ["dst"], "x")
    return out.select("dst", F.round("value", 6).alias("value"))


@query(FIELD + """, p AS (SELECT c_custkey AS dst, (c_custkey % 90) / 10.0 AS px, (c_custkey % 60) / 10.0 AS py FROM customer),
q AS (SELECT dst, least(floor(px), 8)::INT AS i0, least(floor(py), 5)::INT AS j0, px - least(floor(px), 8) AS a, py - least(floor(py), 5) AS b FROM p),
c AS (SELECT dst, i0 AS i, j0 AS j, (1 - a) * (1 - b) AS w FROM q UNION ALL SELECT dst, i0 + 1, j0, a * (1 - b) FROM q UNION ALL SELECT dst, i0 + 1, j0 + 1, a * b FROM q UNION ALL SELECT dst, i0, j0 + 1, (1 - a) * b FROM q)
SELECT dst, round(sum(x * w) / sum(w), 6) AS value FROM c JOIN f USING (i, j) GROUP BY dst""")
def regrid_bilinear(spark, folder):
    points = table(spark, folder, "customer").select(F.col("c_custkey").alias("dst"), (F.col("c_custkey") % 90 / 10.0).alias("x"), (F.col("c_custkey") % 60 / 10.0).alias("y"))
    weights = regrid.bilinear_weights(points, [float(i) for i in range(10)], [float(j) for j in range(7)])
    weights = weights.select("dst", (F.col("i") - 1).alias("i"), (F.col("j") - 1).alias("j"), "w")
    out = regrid.apply_weights(_field(spark, folder), weights, ["i", "j"], ["dst"], "x")
    return out.select("dst", F.round("value", 6).alias("value"))


@query(FIELD + """, c AS (SELECT c_custkey AS dst, (c_custkey + k) % 10 AS i, (c_custkey + 2 * k) % 7 AS j, 0.25 AS w FROM customer, range(4) t(k)),
g AS (SELECT c.*, CASE WHEN (c.i + c.j) % 4 <> 0 THEN x END AS v FROM c LEFT JOIN f USING (i, j))
SELECT dst, CASE WHEN count(*) - count(v) <= 1 THEN round(sum(v * w) / sum(w) FILTER (v IS NOT NULL), 6) END AS value FROM g GROUP BY dst""")
def regrid_missing(spark, folder):
    k = F.explode(F.sequence(F.lit(0), F.lit(3)))
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("dst"), k.alias("k"))
    c = c.select("dst", ((F.col("dst") + F.col("k")) % 10).alias("i"), ((F.col("dst") + 2 * F.col("k")) % 7).alias("j"), F.lit(0.25).alias("w"))
    field = _field(spark, folder).withColumn("x", F.when((F.col("i") + F.col("j")) % 4 != 0, F.col("x")))
    out = regrid.apply_weights(field, c, ["i", "j"], ["dst"], "x", missing_permit=1)
    return out.select("dst", F.round("value", 6).alias("value"))


GOLDEN = 2.399963229728653


@query(f"""
WITH s AS (SELECT s_suppkey AS src, (s_suppkey * {GOLDEN}) % (2 * pi()) AS lon, asin(((s_suppkey * 37) % 199 - 99) / 100.0::DOUBLE) AS lat FROM supplier),
d AS (SELECT c_custkey AS dst, (c_custkey * {GOLDEN} * 1.7) % (2 * pi()) AS lon, asin(((c_custkey * 53) % 199 - 99) / 100.5::DOUBLE) AS lat FROM customer),
p AS (SELECT dst, src, acos(greatest(-1, least(1, sin(s.lat) * sin(d.lat) + cos(s.lat) * cos(d.lat) * cos(s.lon - d.lon)))) AS distance FROM s, d),
r AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY distance, src) AS rank FROM p WHERE distance <= 0.4)
SELECT dst, round(sum(src / distance) / sum(1 / distance), 4) AS value, count(*) AS n FROM r WHERE rank <= 4 GROUP BY dst""")
def knn_idw(spark, folder):
    turn = F.lit(2 * math.pi)
    s = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("src"), ((F.col("s_suppkey") * GOLDEN) % turn).alias("lon"), F.asin(((F.col("s_suppkey") * 37) % 199 - 99) / 100.0).alias("lat"))
    d = table(spark, folder, "customer").select(F.col("c_custkey").alias("dst"), ((F.col("c_custkey") * GOLDEN * 1.7) % turn).alias("lon"), F.asin(((F.col("c_custkey") * 53) % 199 - 99) / 100.5).alias("lat"))
    near = regrid.inverse_distance(regrid.nearest_points(s, d, 4, 0.4))
    out = near.groupBy("dst").agg((F.sum(F.col("src") * F.col("w")) / F.sum("w")).alias("value"), F.count("*").alias("n"))
    return out.select("dst", F.round("value", 4).alias("value"), "n")


@query(f"""
WITH s AS (SELECT s_suppkey AS src, (s_suppkey * {GOLDEN}) % (2 * pi()) AS lon, asin(((s_suppkey * 37) % 199 - 99) / 100.0::DOUBLE) AS lat, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey END AS x FROM supplier),
d AS (SELECT c_custkey AS dst, (c_custkey * {GOLDEN} * 1.7) % (2 * pi()) AS lon, asin(((c_custkey * 53) % 199 - 99) / 100.5::DOUBLE) AS lat FROM customer),
p AS (SELECT dst, src, x, acos(greatest(-1, least(1, sin(s.lat) * sin(d.lat) + cos(s.lat) * cos(d.lat) * cos(s.lon - d.lon)))) AS distance FROM s, d),
r AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY distance, src) AS rank FROM p WHERE distance <= 0.4)
SELECT dst, CASE WHEN bool_or(rank = 1 AND x IS NOT NULL) THEN round(sum(x / distance) / sum(1 / distance) FILTER (x IS NOT NULL), 4) END AS value FROM r WHERE rank <= 4 GROUP BY dst""")
def masked_idw(spark, folder):
    """A third of the sources is masked; targets nearest to one of these are missing."""
    turn = F.lit(2 * math.pi)
    s = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("src"), ((F.col("s_suppkey") * GOLDEN) % turn).alias("lon"), F.asin(((F.col("s_suppkey") * 37) % 199 - 99) / 100.0).alias("lat"))
    d = table(spark, folder, "customer").select(F.col("c_custkey").alias("dst"), ((F.col("c_custkey") * GOLDEN * 1.7) % turn).alias("lon"), F.asin(((F.col("c_custkey") * 53) % 199 - 99) / 100.5).alias("lat"))
    field = s.select("src", F.when(F.col("src") % 3 != 0, F.col("src").cast("double")).alias("x"))
    out = regrid.apply_inverse_distance(field, regrid.nearest_points(s, d, 4, 0.4), "x")
    return out.select("dst", F.round("value", 4).alias("value"))


@query("""
WITH f AS (SELECT l_suppkey % 36 AS src, sum(l_quantity::DECIMAL(18,2))::DOUBLE / count(*) AS x FROM lineitem GROUP BY ALL),
s AS (SELECT i AS src, i * 10.0 AS lo, i * 10.0 + 10 AS hi FROM range(36) t(i)), d AS (SELECT i AS dst, i * 45.0 AS lo, i * 45.0 + 45 AS hi FROM range(8) t(i)),
o AS (SELECT src, dst, least(s.hi, d.hi) - greatest(s.lo, d.lo) AS w FROM s JOIN d ON s.lo < d.hi AND d.lo < s.hi)
SELECT dst, round(sqrt(greatest(0, sum(x * x * w) / sum(w) - (sum(x * w) / sum(w)) * (sum(x * w) / sum(w)))), 4) AS deviation FROM o JOIN f USING (src) GROUP BY dst""")
def overlap_deviation(spark, folder):
    field = table(spark, folder, "lineitem").groupBy((F.col("l_suppkey") % 36).alias("src"))
    field = field.agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("s"), F.count("*").alias("n")).select("src", (F.col("s") / F.col("n")).alias("x"))
    edges = lambda name, n, w: spark.range(n).select(F.col("id").alias(name), (F.col("id") * w).alias("lo"), (F.col("id") * w + w).alias("hi"))
    out = regrid.conserve_deviation(field, edges("src", 36, 10.0), edges("dst", 8, 45.0), "x", 45.0)
    return out.select("dst", F.round("deviation", 4).alias("deviation"))


@query("""
WITH s AS (SELECT s_suppkey, s_suppkey % 12 * 10 - 55.0::DOUBLE AS y FROM supplier),
v AS (SELECT * FROM (VALUES (0, -5, -3), (1, -3, -5), (2, 3, -5), (3, 5, -3), (4, 5, 3), (5, 3, 5), (6, -3, 5), (7, -5, 3)) t(n, a, b)),
e AS (SELECT s_suppkey, radians((q.a - p.a)::DOUBLE) AS dx, radians(y + p.b) AS one, radians(y + q.b) AS two FROM s, v p JOIN v q ON q.n = (p.n + 1) % 8)
SELECT s_suppkey AS src, s_suppkey AS dst, round(-sum(dx * sin((one + two) / 2) * CASE WHEN one = two THEN 1 ELSE sin((one - two) / 2) / ((one - two) / 2) END), 9) AS area FROM e GROUP BY s_suppkey""")
def polygon_overlap(spark, folder):
    """Overlap areas of a rotated square per supplier with the 10-degree box it is centred in."""
    deg = math.pi / 180
    s = table(spark, folder, "supplier").select("s_suppkey", ((F.col("s_suppkey") % 36) * 10 + 5.0).alias("x"), (F.col("s_suppkey") % 12 * 10 - 55.0).alias("y"))
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((-8.0, 0.0), (0.0, -8.0), (8.0, 0.0), (0.0, 8.0))])
    pairs = s.select(
        F.col("s_suppkey").alias("src"), F.col("s_suppkey").alias("dst"),
        F.transform(around, lambda p: (F.col("x") + p["a"]) * deg).alias("lon"), F.transform(around, lambda p: (F.col("y") + p["b"]) * deg).alias("lat"),
        ((F.col("x") - 5) * deg).alias("lon0"), ((F.col("y") - 5) * deg).alias("lat0"), ((F.col("x") + 5) * deg).alias("lon1"), ((F.col("y") + 5) * deg).alias("lat1"),
    )
    return regrid.clip_overlaps(pairs).select("src", "dst", F.round("w", 9).alias("area"))


@query("SELECT c_custkey, round((c_custkey % 5) * (1 + c_custkey % 11 / 11.0::DOUBLE) + 2 * (1 + c_custkey % 7 / 7.0::DOUBLE), 6) AS value FROM customer")
def regrid_bicubic(spark, folder):
    points = table(spark, folder, "customer").select("c_custkey", (F.col("c_custkey") % 11 / 11.0).alias("t"), (F.col("c_custkey") % 7 / 7.0).alias("u"))
    shape = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda n: ((n % 4) * (F.col("c_custkey") % 5) + F.floor(n / 4) * 2).cast("double"))
    return regrid.bicubic(points.withColumn("f", shape), ["c_custkey"]).select("c_custkey", F.round("value", 6).alias("value"))


@query("""
WITH m AS (SELECT month(o_orderdate) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*) AS x FROM orders GROUP BY ALL),
c AS (SELECT (n - 1) * 30.0 AS d, x FROM m), s AS (SELECT d AS t1, x AS x1, lead(d) OVER (ORDER BY d) AS t2, lead(x) OVER (ORDER BY d) AS x2 FROM c),
w AS (SELECT * FROM s WHERE t2 IS NOT NULL UNION ALL SELECT 330.0, (SELECT x FROM c WHERE d = 330), 365.0, (SELECT x FROM c WHERE d = 0)),
e AS (SELECT event_id, (epoch_us(ts) // 86400000000) % 365 AS d FROM events)
SELECT event_id, round((1 - (d - t1) / (t2 - t1)) * x1 + (d - t1) / (t2 - t1) * x2, 4) AS value FROM e JOIN w ON d >= t1 AND d < t2""")
def asof_modulo_year(spark, folder):
    months = table(spark, folder, "orders").groupBy(F.month("o_orderdate").alias("n"))
    months = months.agg((F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / F.count("*")).alias("x"))
    spans = asof.intervals(months.select(((F.col("n") - 1) * 30.0).alias("d"), "x"), "d", "x", period=365)
    day = F.pmod(F.floor(F.col("t") / DAY), F.lit(365))
    out = asof.interpolate_list(_events(spark, folder), spans, day)
    return out.select("event_id", F.round("interpolated", 4).alias("value"))


@query("""
WITH s AS (SELECT l_suppkey, l_linenumber, sum(l_quantity::DECIMAL(18,2))::DOUBLE / count(*) AS q FROM lineitem WHERE l_linenumber <= 4 GROUP BY ALL),
src AS (SELECT l_suppkey, slice, 10.0 * n AS top, 10.0 * n + 10 AS bottom, CASE WHEN l_suppkey % 7 = 0 AND slice = 10 AND n = 0 THEN NULL ELSE q END AS q FROM (SELECT l_suppkey, (l_linenumber - 1) % 2 * 10 AS slice, (l_linenumber - 1) // 2 AS n, q FROM s)),
blend AS (SELECT l_suppkey, top, bottom, CASE WHEN count(q) = 2 THEN sum(q * CASE slice WHEN 0 THEN 0.75 ELSE 0.25 END) END AS q FROM src GROUP BY ALL),
m AS (SELECT DISTINCT l_suppkey, k, 5.0 * k AS top, 5.0 * k + 5 AS bottom FROM lineitem, (VALUES (0), (1), (3)) v(k)),
x AS (SELECT l_suppkey, top, CASE WHEN bottom = max(bottom) OVER (PARTITION BY l_suppkey) THEN greatest(bottom, 20) ELSE bottom END AS bottom, q FROM blend)
SELECT m.l_suppkey, m.k, CASE WHEN NOT bool_or(q IS NULL AND least(x.bottom, m.bottom) > greatest(x.top, m.top)) THEN round(coalesce(sum(greatest(least(x.bottom, m.bottom) - greatest(x.top, m.top), 0) * q / 5), 0), 6) END AS value
FROM m JOIN x USING (l_suppkey) GROUP BY ALL""")
def climatology_columns(spark, folder):
    """A seventh of the columns misses a layer in one slice: missing at all times between."""
    lines = table(spark, folder, "lineitem")
    n = F.col("l_linenumber") - 1
    means = lines.where("l_linenumber <= 4").groupBy("l_suppkey", "l_linenumber").agg((F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double") / F.count("*")).alias("q"))
    level = F.floor(n / 2) * 10.0
    source = means.select("l_suppkey", (n % 2 * 10).cast("long").alias("t"), level.alias("top"), (level + 10).alias("bottom"), F.when((F.col("l_suppkey") % 7 != 0) | (n != 1), F.col("q")).alias("q"))
    model = lines.select("l_suppkey").distinct().select("l_suppkey", F.explode(F.array(*map(F.lit, (0, 1, 3)))).alias("k"))
    model = model.select("l_suppkey", F.lit(2.5).alias("t"), "k", (F.col("k") * 5.0).alias("top"), (F.col("k") * 5.0 + 5).alias("bottom"))
    out = climatology(source, model, ["l_suppkey"])
    return out.select("l_suppkey", "k", F.round("value", 6).alias("value"))


@query("""
WITH p AS (SELECT c_custkey, (c_custkey * 37 % 100) / 10.0 + 0.013 AS x, (c_custkey * 53 % 100) / 10.0 + 0.017 AS y FROM customer)
SELECT c_custkey AS dst, (floor(y) * 10 + floor(x - 0.3 * y + 3))::BIGINT AS cell FROM p WHERE floor(x - 0.3 * y + 3) < 10""")
def containing_cells(spark, folder):
    """Cells leaning by 0.3 a row: column i, row j starts at x = i - 3 + 0.3 y."""
    key = F.col("c_custkey")
    points = table(spark, folder, "customer").select(key.alias("dst"), (key * 37 % 100 / 10.0 + 0.013).alias("x"), (key * 53 % 100 / 10.0 + 0.017).alias("y"))
    i, j = F.col("id") % 10, F.floor(F.col("id") / 10)
    x = i - 3 + 0.3 * j
    quads = spark.range(100).select(
        F.col("id").alias("cell"), x.alias("x1"), j.alias("y1"), (x + 1).alias("x2"), j.alias("y2"), (x + 1.3).alias("x3"), (j + 1).alias("y3"),
        (x + 0.3).alias("x4"), (j + 1).alias("y4"),
    )
    return regrid.containing_cells(points, quads, 1.0)


@query("""
WITH s AS (SELECT l_suppkey, l_linenumber AS n, sum(l_quantity::DECIMAL(18,2))::DOUBLE / count(*) AS q FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL),
l AS (SELECT l_suppkey, 10.0 * n AS p1, q AS q1, lead(10.0 * n) OVER w AS p2, lead(q) OVER w AS q2, row_number() OVER w AS r, count(*) OVER (PARTITION BY l_suppkey) AS c FROM s WINDOW w AS (PARTITION BY l_suppkey ORDER BY n)),
m AS (SELECT DISTINCT l_suppkey, k, 7.0 * k AS p FROM lineitem, range(6) t(k))
SELECT l_suppkey, k, round(q1 + (p - p1) * (q2 - q1) / (p2 - p1), 6) AS value FROM m JOIN l USING (l_suppkey) WHERE p2 IS NOT NULL AND (p >= p1 OR r = 1) AND (p < p2 OR r = c - 1)""")
def climatology_half_levels(spark, folder):
    """Linear between upper half-levels, which both ends extrapolate."""
    lines = table(spark, folder, "lineitem")
    means = lines.where("l_linenumber <= 3").groupBy("l_suppkey", "l_linenumber").agg((F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double") / F.count("*")).alias("q"))
    top = F.col("l_linenumber") * 10.0
    source = means.select("l_suppkey", top.alias("top"), (top + 10).alias("bottom"), "q")
    source = source.select("l_suppkey", F.explode(F.expr("array(0L, 10L)")).alias("t"), "top", "bottom", "q")
    model = lines.select("l_suppkey").distinct().select("l_suppkey", F.lit(2.5).alias("t"), F.explode(F.expr("sequence(0L, 5L)")).alias("k"))
    model = model.withColumn("top", F.col("k") * 7.0).withColumn("bottom", F.col("k") * 7.0 + 7)
    out = climatology(source, model, ["l_suppkey"], vertical="linear")
    return out.select("l_suppkey", "k", F.round("value", 6).alias("value"))


@query(FIELD + """, t AS (SELECT 0 AS s, i, j, x FROM f UNION ALL SELECT 6, i, j, CASE WHEN i BETWEEN 3 AND 4 AND j BETWEEN 2 AND 3 THEN NULL ELSE 2 * x END FROM f),
p AS (SELECT c_custkey AS dst, (c_custkey % 90) / 10.0 AS px, (c_custkey % 60) / 10.0 AS py FROM customer),
q AS (SELECT dst, px, py, least(floor(px), 8)::INT AS i0, least(floor(py), 5)::INT AS j0, px - least(floor(px), 8) AS a, py - least(floor(py), 5) AS b FROM p),
c AS (SELECT dst, i0 AS i, j0 AS j, (1 - a) * (1 - b) AS w FROM q UNION ALL SELECT dst, i0 + 1, j0, a * (1 - b) FROM q UNION ALL SELECT dst, i0 + 1, j0 + 1, a * b FROM q UNION ALL SELECT dst, i0, j0 + 1, (1 - a) * b FROM q),
m AS (SELECT dst, sum(x * w) FILTER (s = 0) / sum(w) FILTER (s = 0 AND x IS NOT NULL) AS a, sum(x * w) FILTER (s = 6) / nullif(sum(w) FILTER (s = 6 AND x IS NOT NULL), 0) AS b FROM c JOIN t USING (i, j) GROUP BY dst),
k AS (SELECT 1 AS k UNION ALL SELECT 2)
SELECT dst, h AS t, k, CASE WHEN px BETWEEN 2 AND 6 AND py BETWEEN 1 AND 4 AND m.a + m.b IS NOT NULL THEN round(0.5 * (m.a * (1 - h / 6.0) + m.b * h / 6.0), 6) ELSE -1.0 END AS value
FROM q LEFT JOIN m USING (dst), k, (SELECT unnest([1.5, 4.5]) AS h)""")
def override_composite(spark, folder):
    """A file's field at two times on a coarse grid over a region of a model with two levels.

    The second time lacks four neighbouring points: cells between them keep the model's value.
    """
    from tidemark.operators.fields import Override, override_from

    key = F.col("c_custkey")
    model = table(spark, folder, "customer").select(key.alias("dst"), (key % 90 / 10.0).alias("lon"), (key % 60 / 10.0).alias("lat"), F.lit(-1.0).alias("x"))
    model = model.withColumn("t", F.explode(F.array(F.lit(1.5), F.lit(4.5)))).withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    f = _field(spark, folder)
    blank = F.col("i").between(3, 4) & F.col("j").between(2, 3)
    slices = f.select(F.lit(0.0).alias("t"), "i", "j", "x").unionByName(f.select(F.lit(6.0).alias("t"), "i", "j", F.when(~blank, 2 * F.col("x")).alias("x")))
    row = Override("ATM", "sst", "sst_obs", 0.5, (2.0, 6.0, 1.0, 4.0))
    out = override_from(model, [row], "ATM", "sst", "x", slices, [float(i) for i in range(10)], [float(j) for j in range(7)])
    return out.select("dst", F.col("t"), "k", F.round("x", 6).alias("value"))


NEAR_POINTS = """, p AS (SELECT c_custkey AS dst, (c_custkey % 90) / 10.0 AS px, (c_custkey % 60) / 10.0 AS py FROM customer),
q AS (SELECT dst, least(floor(px), 8)::INT AS i0, least(floor(py), 5)::INT AS j0, px - least(floor(px), 8) AS wx, py - least(floor(py), 5) AS wy FROM p),
h AS (SELECT i, j, x FROM f WHERE (i * 7 + j * 5) % 11 > 3),
c AS (SELECT q.*, a.x AS sw, b.x AS se, d.x AS ne, e.x AS nw FROM q LEFT JOIN h a ON a.i = i0 AND a.j = j0 LEFT JOIN h b ON b.i = i0 + 1 AND b.j = j0 LEFT JOIN h d ON d.i = i0 + 1 AND d.j = j0 + 1 LEFT JOIN h e ON e.i = i0 AND e.j = j0 + 1),
n AS (SELECT *, (sw IS NULL)::INT + (se IS NULL)::INT + (ne IS NULL)::INT + (nw IS NULL)::INT AS gone FROM c),
z AS (SELECT *, CASE WHEN wx <= 0.5 AND wy <= 0.5 THEN 1 WHEN wx >= 0.5 AND wy <= 0.5 THEN 2 WHEN wx >= 0.5 THEN 3 ELSE 4 END AS zone,
  (sw IS NULL AND wx <= 0.5 AND wy <= 0.5) OR (se IS NULL AND wx >= 0.5 AND wy <= 0.5) OR (ne IS NULL AND wx >= 0.5 AND wy >= 0.5) OR (nw IS NULL AND wx <= 0.5 AND wy >= 0.5) AS lost,
  CASE WHEN gone = 1 THEN CASE WHEN sw IS NULL OR ne IS NULL THEN (se + nw) / 2 ELSE (sw + ne) / 2 END ELSE list_avg(list_filter([sw, se, ne, nw], lambda v: v IS NOT NULL)) END AS middle FROM n),
r AS (SELECT *, CASE zone WHEN 1 THEN [sw, coalesce((sw + se) / 2, sw), coalesce((sw + nw) / 2, sw)] WHEN 2 THEN [se, coalesce((sw + se) / 2, se), coalesce((se + ne) / 2, se)]
  WHEN 3 THEN [ne, coalesce((nw + ne) / 2, ne), coalesce((se + ne) / 2, ne)] ELSE [nw, coalesce((nw + ne) / 2, nw), coalesce((nw + sw) / 2, nw)] END AS v, abs(1 - 2 * wx) AS a, abs(1 - 2 * wy) AS b FROM z)
SELECT dst, CASE WHEN gone = 0 THEN round((1 - wx) * (1 - wy) * sw + wx * (1 - wy) * se + wx * wy * ne + (1 - wx) * wy * nw, 6)
  WHEN gone < 4 AND NOT lost THEN round(a * b * v[1] + (1 - a) * b * v[2] + a * (1 - b) * v[3] + (1 - a) * (1 - b) * middle, 6) END AS value FROM r"""


@query(FIELD + NEAR_POINTS)
def bilinear_missing(spark, folder):
    """A third of the points is missing: each target keeps to the quadrant it lies in."""
    points = table(spark, folder, "customer").select(F.col("c_custkey").alias("dst"), (F.col("c_custkey") % 90 / 10.0).alias("x"), (F.col("c_custkey") % 60 / 10.0).alias("y"))
    field = _field(spark, folder).where("(i * 7 + j * 5) % 11 > 3")
    out = regrid.bilinear_near(field, points, [float(i) for i in range(10)], [float(j) for j in range(7)], "x")
    return out.select("dst", F.round("value", 6).alias("value"))


@query("""
WITH s AS (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, o_orderpriority AS p, sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*) AS x FROM orders WHERE year(o_orderdate) IN (1995, 1998) GROUP BY ALL),
t AS (SELECT DISTINCT o_orderdate::TIMESTAMP AS t FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-15' AND TIMESTAMP '1998-12-15'),
b AS (SELECT t, CASE WHEN t < date_trunc('month', t) + INTERVAL 14 DAY THEN date_trunc('month', t) - INTERVAL 1 MONTH ELSE date_trunc('month', t) END AS a FROM t),
w AS (SELECT t, a, a + INTERVAL 1 MONTH AS b, (epoch(t) - epoch(a + INTERVAL 14 DAY)) / (epoch(a + INTERVAL 1 MONTH) - epoch(a)) AS w FROM b),
e AS (SELECT t, a AS moment, 1 - w AS w FROM w UNION ALL SELECT t, b, w FROM w),
y AS (SELECT *, month(moment) AS m, CASE WHEN year(moment) >= 1998 THEN 1998 ELSE 1995 END AS lo, CASE WHEN year(moment) <= 1995 THEN 1995 ELSE 1998 END AS hi FROM e),
z AS (SELECT *, CASE WHEN lo = hi THEN 0 ELSE (epoch(moment) - epoch(make_date(lo, m, 1))) / (epoch(make_date(hi, m, 1)) - epoch(make_date(lo, m, 1)))::DOUBLE END AS share FROM y),
u AS (SELECT t, m, yy, sum(ww) AS w FROM (SELECT t, m, lo AS yy, (1 - share) * w AS ww FROM z UNION ALL SELECT t, m, hi, share * w FROM z) GROUP BY ALL HAVING sum(ww) > 0)
SELECT t, p, CASE WHEN count(x) = (SELECT count(*) FROM u v WHERE v.t = u.t) THEN round(sum(x * w) / pi(), 4) END AS x FROM u JOIN s ON s.y = yy AND s.m = u.m GROUP BY t, p""")
def climatology_month_year(spark, folder):
    """Monthly means of two years that do not follow one another, at all days of orders between them."""
    from tidemark.operators.climatology import months_between_years

    df = table(spark, folder, "orders")
    year = F.year("o_orderdate")
    means = df.where(year.isin(1995, 1998)).groupBy(year.alias("year"), F.month("o_orderdate").alias("month"), F.col("o_orderpriority").alias("p"))
    source = means.agg((F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / F.count("*")).alias("x")).withColumn("day", F.lit(15))
    out = months_between_years(source, df.select(F.col("o_orderdate").alias("t")), ["p"])
    return out.select("t", "p", F.round(F.col("x") / math.pi, 4).alias("x"))  # no mean of cents lies half-way then


UNEVEN_X, UNEVEN_Y = [0.0, 30.0, 65.0, 100.0, 150.0, 190.0, 240.0, 275.0, 300.0, 335.0], [-60.0, -35.0, -20.0, 0.0, 15.0, 40.0, 70.0]


def _cubic_sql(value: str, n: int, points: str, period: str | None) -> str:
    """Four rows ``dst, k, w`` a target: a cubic's weights along one axis ``points(k, p)``."""
    gap = lambda a, b: f"({b} - {a} + CASE WHEN {b} < {a} THEN {period} ELSE 0 END)" if period else f"({b} - {a})"
    wrap = (lambda e: f"(({e}) + {n}) % {n}") if period else (lambda e: f"greatest(0, least({n - 1}, {e}))")
    return f"""SELECT dst, unnest([{wrap('lo - 1')}, lo, hi, {wrap('hi + 1')}]) AS k, unnest([-h10 * l, h00 - h11 * r, h01 + h10 * l, h11 * r]) AS w FROM (
  SELECT b.*, (1 + 2 * t) * (1 - t) ** 2 AS h00, t * (1 - t) ** 2 AS h10, t * t * (3 - 2 * t) AS h01, t * t * (t - 1) AS h11, {gap('pl', 'ph')} / {gap('m.p', 'ph')} AS l, {gap('pl', 'ph')} / {gap('pl', 'q.p')} AS r
  FROM (SELECT a.dst, a.lo, a.hi, x.p AS pl, y.p AS ph, (v - x.p + {f'CASE WHEN v < x.p THEN {period} ELSE 0 END' if period else '0'}) / {gap('x.p', 'y.p')} AS t
    FROM (SELECT dst, {value} AS v, {f"(count_if({points}.p <= {value}) - 1 + {n}) % {n}" if period else f"least(count_if({points}.p <= {value}) - 1, {n - 2})"} AS lo, ({f"(count_if({points}.p <= {value}) - 1 + {n}) % {n} + 1) % {n}" if period else f"least(count_if({points}.p <= {value}) - 1, {n - 2}) + 1)"} AS hi FROM p, {points} GROUP BY dst, {value}) a
    JOIN {points} x ON x.k = lo JOIN {points} y ON y.k = hi) b JOIN {points} m ON m.k = {wrap('lo - 1')} JOIN {points} q ON q.k = {wrap('hi + 1')})"""


def _axis_sql(axis: list[float]) -> str:
    return "SELECT unnest(range(%d)) AS k, unnest([%s])::DOUBLE AS p" % (len(axis), ", ".join(map(str, axis)))


@query(FIELD + f""", xa AS ({_axis_sql(UNEVEN_X)}), ya AS ({_axis_sql(UNEVEN_Y)}),
p AS (SELECT c_custkey AS dst, (c_custkey * 37 % 3600) / 10.0::DOUBLE AS px, (c_custkey * 53 % 1300) / 10.0::DOUBLE - 60 AS py FROM customer),
wx AS ({_cubic_sql('px', 10, 'xa', '360')}), wy AS ({_cubic_sql('py', 7, 'ya', None)})
SELECT a.dst, round(sum(a.w * b.w * x), 6) AS value FROM wx a JOIN wy b USING (dst) JOIN f ON f.i = a.k AND f.j = b.k GROUP BY a.dst""")
def bicubic_field(spark, folder):
    """Sixteen points around each target, uneven steps, longitudes that close, one-sided slopes at the last latitudes."""
    from tidemark.operators.interpolation import interpolate, make_weights

    key = F.col("c_custkey")
    points = table(spark, folder, "customer").select(key.alias("dst"), (key * 37 % 3600 / 10.0).alias("x"), (key * 53 % 1300 / 10.0 - 60).alias("y"))
    field = _field(spark, folder).select((F.col("j") * 10 + F.col("i")).cast("long").alias("src"), "x")
    out = interpolate(field, make_weights("bicubic", points, axes=(UNEVEN_X, UNEVEN_Y), cyclic=360.0), "x")
    return out.select("dst", F.round("x", 6).alias("value"))


@query(BOXES + """, z AS (SELECT l_returnflag AS level, l_suppkey % 36 AS i, l_linenumber - 1 AS j, max(l_quantity) AS x FROM lineitem GROUP BY ALL),
e AS (SELECT t.dst, level FROM t, (SELECT DISTINCT level FROM z)), m AS (SELECT dst, level, sum(x * w) AS x, sum(w) AS w FROM o JOIN z USING (i, j) GROUP BY ALL), a AS (SELECT dst, sum(w) AS w FROM o GROUP BY dst)
SELECT e.dst, e.level, round(coalesce(m.x / m.w, 0), 6) AS value, round(coalesce(m.w / a.w, 0), 6) AS mask FROM e LEFT JOIN m USING (dst, level) LEFT JOIN a ON a.dst = e.dst""")
def regrid_front(spark, folder):
    """Conservative weights written, read again and applied to a field of several levels."""
    from tidemark.functions.tables import scratch_folder
    from tidemark.operators.interpolation import interpolate, read_weights, write_weights

    overlap, target = _boxes(spark)
    path = f"{scratch_folder(spark)}/tidemark-weights-{uuid.uuid4().hex}"
    write_weights(overlap.withMetadata("w", {"method": "conservative"}), path)
    src = (F.col("l_suppkey") % 36) * 100 + F.col("l_linenumber") - 1
    field = table(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("level"), src.alias("src")).agg(F.max("l_quantity").alias("x"))
    out = interpolate(field, read_weights(spark, path), "x", target=target)
    return out.select("dst", "level", F.round("x", 6).alias("value"), F.round("mask", 6).alias("mask"))


@query(FIELD + """, p AS (SELECT c_custkey AS point, (c_custkey % 90) / 10.0 AS px, (c_custkey % 60) / 10.0 AS py FROM customer WHERE c_custkey % 4 <> 1),
q AS (SELECT point, px, py, least(floor(px), 8)::INT AS i0, least(floor(py), 5)::INT AS j0, px - least(floor(px), 8) AS a, py - least(floor(py), 5) AS b FROM p),
c AS (SELECT point, i0 AS i, j0 AS j, (1 - a) * (1 - b) AS w FROM q UNION ALL SELECT point, i0 + 1, j0, a * (1 - b) FROM q UNION ALL SELECT point, i0 + 1, j0 + 1, a * b FROM q UNION ALL SELECT point, i0, j0 + 1, (1 - a) * b FROM q),
m AS (SELECT point, sum(x * w) / sum(w) AS x FROM c JOIN f USING (i, j) GROUP BY point)
SELECT point, CASE WHEN px BETWEEN 2 AND 6 AND py BETWEEN 1 AND 4 THEN -1.0 ELSE round(2 * x * 1.25, 6) END AS value FROM q JOIN m USING (point)""")
def override_points(spark, folder):
    """A list of points (no grid) overridden outside a region, half-way between two times."""
    from tidemark.operators.fields import Override, override_from

    key = F.col("c_custkey")
    model = table(spark, folder, "customer").where(key % 4 != 1).select(key.alias("dst"), (key % 90 / 10.0).alias("lon"), (key % 60 / 10.0).alias("lat"), F.lit(-1.0).alias("x"), F.lit(3.0).alias("t"))
    f = _field(spark, folder)
    slices = f.select(F.lit(0.0).alias("t"), "i", "j", "x").unionByName(f.select(F.lit(6.0).alias("t"), "i", "j", (1.5 * F.col("x")).alias("x")))
    row = Override("LND", "soil", "soil_obs", 2.0, (2.0, 6.0, 1.0, 4.0), outside=True)
    out = override_from(model, [row], "LND", "soil", "x", slices, [float(i) for i in range(10)], [float(j) for j in range(7)])
    return out.select(F.col("dst").alias("point"), F.round("x", 6).alias("value"))
