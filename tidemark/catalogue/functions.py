"""Calendars, physics, geometry and configuration trees as column functions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.catalogue.registry import query, table
from tidemark.functions import calendar as cal
from tidemark.functions import geometry as geo
from tidemark.functions import physics as ph
from tidemark.operators.windows import micros

BEFORE = "[0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334]"


def _dates(spark, folder):
    d = F.col("o_orderdate")
    return table(spark, folder, "orders").select("o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.dayofmonth(d).alias("d"))


def _number(expression: str, valid: str = "true") -> str:
    """Dates to day numbers; back again gives the date itself. Days that the calendar lacks are null."""
    return f"""WITH o AS (SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d FROM orders),
n AS (SELECT *, CASE WHEN {valid} THEN {expression} END AS days FROM o)
SELECT o_orderkey, days::BIGINT AS days, CASE WHEN days IS NOT NULL THEN y::BIGINT END AS y, CASE WHEN days IS NOT NULL THEN m::BIGINT END AS m,
  CASE WHEN days IS NOT NULL THEN d::BIGINT END AS d FROM n"""


def _round_trip(spark, folder, calendar):
    df = _dates(spark, folder)
    df = df.select("o_orderkey", cal.set_date(F.col("y"), F.col("m"), F.col("d"), calendar, strict=False).alias("days"))
    y, m, d = cal.get_date(F.col("days"), calendar)
    return df.select("o_orderkey", "days", *[c.cast("long").alias(n) for c, n in ((y, "y"), (m, "m"), (d, "d"))])


@query(_number("date_diff('day', DATE '0001-01-01', make_date(y, m, d))"))
def calendar_roundtrip_gregorian(spark, folder):
    return _round_trip(spark, folder, "gregorian")


@query(_number(f"(y - 1) * 365 + (y - 1) // 4 + ({BEFORE})[m] + (CASE WHEN y % 4 = 0 AND m > 2 THEN 1 ELSE 0 END) + d - 1"))
def calendar_roundtrip_julian(spark, folder):
    return _round_trip(spark, folder, "julian")


@query(_number(f"(y - 1) * 365 + ({BEFORE})[m] + d - 1", "NOT (m = 2 AND d = 29)"))
def calendar_roundtrip_noleap(spark, folder):
    return _round_trip(spark, folder, "noleap")


@query(_number("(y - 1) * 360 + (m - 1) * 30 + d - 1", "d <= 30"))
def calendar_roundtrip_thirty(spark, folder):
    return _round_trip(spark, folder, "thirty_day")


@query("""
WITH o AS (SELECT o_orderkey, day(o_orderdate) AS d, (make_date(year(o_orderdate), month(o_orderdate), 1) + INTERVAL 14 MONTH)::DATE AS f FROM orders)
SELECT o_orderkey, CASE WHEN d <= day(last_day(f)) THEN date_diff('day', DATE '0001-01-01', f) + d - 1 END AS days FROM o""")
def increment_date(spark, folder):
    """Fourteen months on; days that the month lacks (an error otherwise) are null."""
    days = cal.increment_months(F.col("y"), F.col("m"), F.col("d"), 14, "gregorian", strict=False)
    return _dates(spark, folder).select("o_orderkey", days.alias("days"))


@query("""
WITH o AS (SELECT o_orderkey, o_orderdate - INTERVAL 90061 SECOND * (o_orderkey % 7) AS t FROM orders)
SELECT o_orderkey, date_diff('day', DATE '0001-01-01', t::DATE) AS days, (epoch_us(t) % 86400000000) // 1000000 AS seconds,
  date_diff('day', DATE '0001-01-01', t::DATE)::DOUBLE * 86400 + (epoch_us(t) % 86400000000) // 1000000 + (o_orderkey % 4) / 4.0::DOUBLE AS real FROM o""")
def time_arithmetic(spark, folder):
    """Dates read from text, some days and seconds before them, and both as one real number."""
    days, seconds = cal.parse_date(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), "gregorian")
    n = -(F.col("o_orderkey") % 7)
    df = table(spark, folder, "orders").select("o_orderkey", days.alias("d"), seconds.alias("s"))
    days, seconds = cal.increment_time(F.col("d"), F.col("s"), n, n * 3661)
    df = df.select("o_orderkey", days.alias("days"), seconds.alias("seconds"))
    return df.withColumn("real", cal.time_as_real(F.col("days"), F.col("seconds"), F.col("o_orderkey") % 4, 4))


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity / 20.0 AS ri FROM lineitem), q AS (SELECT *, 1 / ri - 0.5 AS a, 1 / ri - 6 AS b FROM r)
SELECT l_orderkey, l_linenumber, round(CASE WHEN ri < 2 THEN pow((-b + sqrt(b * b + 4 * a)) / (2 * a) / ri, -2) ELSE 0 END, 6) AS mix FROM q""")
def mo_stable_mix_default(spark, folder):
    """The default option; the SQL takes 1 / phi^2 as (ri / zeta)^2, which holds only at the root."""
    ri = F.col("l_quantity") / 20.0
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.round(ph.stable_mix(ri, 1), 6).alias("mix"))


@query("""
WITH v AS (SELECT o_orderkey, o_orderkey % 200 AS w, (o_orderkey % 8) / 8.0::DOUBLE AS f, (DATE '1990-01-01' + to_months((o_orderkey % 200)::INT))::DATE AS b FROM orders),
x AS (SELECT o_orderkey, date_diff('day', DATE '0001-01-01', b) + f * day(last_day(b)) AS e FROM v)
SELECT o_orderkey, floor(e)::BIGINT AS days, floor((e - floor(e)) * 86400)::BIGINT AS seconds FROM x""")
def get_cal_time(spark, folder):
    value = F.col("o_orderkey") % 200 + F.col("o_orderkey") % 8 / 8.0
    days, seconds = cal.calendar_time(value, "months", (1990, 1, 1), "gregorian")
    return table(spark, folder, "orders").select("o_orderkey", days.alias("days"), seconds.alias("seconds"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') || '.000000' AS stamp, strftime(o_orderdate, '%B') AS month, dayofyear(o_orderdate)::INTEGER AS doy,
 round((dayofyear(o_orderdate) - 1) / (365 + (CASE WHEN year(o_orderdate) % 4 = 0 THEN 1 ELSE 0 END))::DOUBLE, 9) AS fraction FROM orders WHERE epoch_us(o_orderdate) % 86400000000 = 0""")
def date_strings(spark, folder):
    o = table(spark, folder, "orders").where(F.pmod(micros(F.col("o_orderdate")), F.lit(86_400_000_000)) == 0)
    y, m, d = F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate")
    days = cal.set_date(y, m, d, "gregorian")
    return o.select(
        "o_orderkey", cal.date_text(days, F.lit(0), "gregorian").alias("stamp"), cal.month_name(m).alias("month"),
        cal.day_of_year(y, m, d, "gregorian").cast("int").alias("doy"), F.round(cal.year_fraction(days, "gregorian"), 9).alias("fraction"),
    )


T = "(240 + l_quantity * 1.5)"
R = "(373.16 / t)"
ES = f"""WITH a AS (SELECT l_orderkey, l_linenumber, {T} AS t, 60000 + l_extendedprice AS p FROM lineitem),
w AS (SELECT *, pow(10, -7.90298 * ({R} - 1) + 5.02808 * log10({R}) - 1.3816e-7 * (pow(10, 11.344 * (1 - 1 / {R})) - 1) + 8.1328e-3 * (pow(10, -3.49149 * ({R} - 1)) - 1) + log10(101324.60)) AS ew,
 pow(10, -9.09718 * (273.16 / t - 1) - 3.56654 * log10(273.16 / t) + 0.876793 * (1 - t / 273.16) + log10(610.71)) AS ei FROM a),
e AS (SELECT *, CASE WHEN t < 253.16 THEN ei WHEN t > 273.16 THEN ew ELSE 0.05 * ((273.16 - t) * ei + (t - 253.16) * ew) END AS es FROM w)"""


def _air(spark, folder):
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", (240 + F.col("l_quantity") * 1.5).alias("t"), (60000 + F.col("l_extendedprice")).alias("p"))


@query(ES + " SELECT l_orderkey, l_linenumber, round(ew, 4) AS water, round(ei, 4) AS ice, round(es, 4) AS es FROM e")
def sat_es(spark, folder):
    t = F.col("t")
    return _air(spark, folder).select("l_orderkey", "l_linenumber", F.round(ph.es_water(t), 4).alias("water"), F.round(ph.es_ice(t), 4).alias("ice"), F.round(ph.es(t), 4).alias("es"))


@query(ES + ", k AS (SELECT 287.04 / 461.50::DOUBLE AS eps) SELECT l_orderkey, l_linenumber, round(eps * es / (p - (1 - eps) * es), 8) AS qs, round(eps * es / (p - es), 8) AS mrs FROM e, k")
def qs_mrs(spark, folder):
    e = ph.es(F.col("t"))
    return _air(spark, folder).select("l_orderkey", "l_linenumber", F.round(ph.saturation_humidity(F.col("p"), e), 8).alias("qs"), F.round(ph.saturation_mixing_ratio(F.col("p"), e), 8).alias("mrs"))


@query("""
WITH z AS (SELECT l_orderkey, l_linenumber, (l_quantity - 20) / 10.0 AS z FROM lineitem)
SELECT l_orderkey, l_linenumber, round(CASE WHEN z < 0 THEN pow(1 - 16 * z, -0.25) ELSE 1 + z * (5 + 0.5 * z) / (1 + z) END, 8) AS phi_m,
 round(CASE WHEN z < 0 THEN pow(1 - 16 * z, -0.5) WHEN z < 0.5 THEN 1 + 5 * z ELSE 1 + 4.5 * 0.5 + 0.5 * z END, 8) AS phi_t FROM z""")
def mo_phi(spark, folder):
    z = (F.col("l_quantity") - 20) / 10.0
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.round(ph.phi_m(z), 8).alias("phi_m"), F.round(ph.phi_t(z, 2), 8).alias("phi_t"))


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity / 20.0 AS ri FROM lineitem), q AS (SELECT *, 0.5 / 3.5 AS cut FROM r)
SELECT l_orderkey, l_linenumber, round(CASE WHEN ri < cut THEN pow(1 - 5 * ri, 2) WHEN ri < 2 THEN pow((1 - 0.5 * ri) / 3.25, 2) ELSE 0 END, 8) AS mix FROM q""")
def mo_stable_mix(spark, folder):
    ri = F.col("l_quantity") / 20.0
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.round(ph.stable_mix(ri, 2), 8).alias("mix"))


@query("""
WITH a AS (SELECT c_custkey, radians(c_custkey % 179 - 89) AS lat, radians(c_custkey * 7 % 360) AS ang FROM customer),
d AS (SELECT *, asin(-sin(radians(23.439)) * sin(ang)) AS dec FROM a), c AS (SELECT *, -tan(lat) * tan(dec) AS c FROM d),
h AS (SELECT *, CASE WHEN c >= 1 THEN 0 WHEN c <= -1 THEN pi() ELSE acos(greatest(-1, least(1, c))) END AS h FROM c)
SELECT c_custkey, round(CASE WHEN h = 0 THEN 0 ELSE greatest(0, sin(lat) * sin(dec) + cos(lat) * cos(dec) * sin(h) / h) END, 8) AS cosz, round(h / pi(), 8) AS fracday,
 round(pow((1 + 0.01671 * cos(ang - radians(102.932))) / (1 - 0.01671 * 0.01671), 2), 8) AS rrsun FROM h""")
def solar_daily(spark, folder):
    lat, angle = F.radians(F.col("c_custkey") % 179 - 89), F.radians(F.col("c_custkey") * 7 % 360)
    cosz, day = ph.daily_mean_cosz(lat, angle)
    return table(spark, folder, "customer").select("c_custkey", F.round(cosz, 8).alias("cosz"), F.round(day, 8).alias("fracday"), F.round(ph.inverse_square_distance(angle), 8).alias("rrsun"))


@query("""
WITH a AS (SELECT c_custkey, radians(c_custkey * 11 % 360) AS lon, radians(c_custkey % 179 - 89) AS lat FROM customer), d AS (SELECT *, least(abs(lon - pi() / 2), abs(abs(lon - pi() / 2) - 2 * pi())) AS dx FROM a)
SELECT c_custkey, round(2000 * exp(-pow(greatest(0, dx) / (pi() / 12), 2) - pow(greatest(0, abs(lat - pi() / 4)) / (pi() / 12), 2)), 6) AS height FROM d""")
def gaussian_topog(spark, folder):
    lon, lat = F.radians(F.col("c_custkey") * 11 % 360), F.radians(F.col("c_custkey") % 179 - 89)
    return table(spark, folder, "customer").select("c_custkey", F.round(ph.gaussian_hill(lon, lat, 2000.0), 6).alias("height"))


@query("""
WITH a AS (SELECT c_custkey, (c_custkey * 97 % 1440 - 720) / 2.0 AS lon FROM customer)
SELECT c_custkey, CASE WHEN abs(lon + 180) < 1e-4 OR abs(lon - 180) < 1e-4 THEN -180.0::DOUBLE ELSE ((lon + 180) - 360 * floor((lon + 180) / 360) - 180)::DOUBLE END AS lon FROM a""")
def lon_wrap(spark, folder):
    lon = (F.col("c_custkey") * 97 % 1440 - 720) / 2.0
    return table(spark, folder, "customer").select("c_custkey", geo.wrap_longitude(lon, -180.0).alias("lon"))


@query("""
WITH a AS (SELECT DISTINCT p_brand, p_size::DOUBLE AS x FROM part), w AS (SELECT *, lag(x) OVER o AS b, lead(x) OVER o AS c FROM a WINDOW o AS (PARTITION BY p_brand ORDER BY x))
SELECT p_brand, x, CASE WHEN b IS NULL THEN x - (c - x) / 2 ELSE (b + x) / 2 END AS low, CASE WHEN c IS NULL THEN x + (x - b) / 2 ELSE (x + c) / 2 END AS high FROM w""")
def axis_edges(spark, folder):
    df = table(spark, folder, "part").select("p_brand", F.col("p_size").cast("double").alias("x")).distinct()
    low, high = geo.edges(["p_brand"], "x")
    return df.select("p_brand", "x", low.alias("low"), high.alias("high"))


@query("""
WITH a AS (SELECT c_custkey, radians(c_custkey * 11 % 360) AS lon, radians(c_custkey % 179 - 89) AS lat, radians(c_custkey * 7 % 360) AS lon2, radians(c_custkey * 3 % 179 - 89) AS lat2 FROM customer)
SELECT c_custkey, round(acos(greatest(-1, least(1, sin(lat) * sin(lat2) + cos(lat) * cos(lat2) * cos(lon - lon2)))), 6) AS distance,
 round(6371.0 * 6371.0 * abs(lon2 - lon) * abs(sin(lat2) - sin(lat)), 2) AS area FROM a""")
def great_circle(spark, folder):
    k = F.col("c_custkey")
    lon, lat, lon2, lat2 = F.radians(k * 11 % 360), F.radians(k % 179 - 89), F.radians(k * 7 % 360), F.radians(k * 3 % 179 - 89)
    return table(spark, folder, "customer").select(
        "c_custkey", F.round(geo.great_circle(lon, lat, lon2, lat2), 6).alias("distance"), F.round(geo.box_area(lon, lon2, lat, lat2, 6371.0), 2).alias("area")
    )


@query("SELECT p_partkey, k::INTEGER AS k, round(100.0 * pow(pow(0.01::DOUBLE, 1 / 4.0::DOUBLE), 5 - k), 8) AS value FROM part, range(1, 6) t(k)")
def tracer_profile(spark, folder):
    k = F.explode(F.sequence(F.lit(1), F.lit(5)))
    df = table(spark, folder, "part").select("p_partkey", k.alias("k"))
    return df.select("p_partkey", "k", F.round(ph.tracer_profile(100.0, 1.0, 5, F.col("k")), 8).alias("value"))


@query("SELECT event_id, '/events/' || event_type || '/' || key AS path, (props->>key) AS value FROM (SELECT event_id, event_type, props::JSON AS props, unnest(json_keys(props::JSON)) AS key FROM events)")
def fm_flatten(spark, folder):
    pairs = F.explode(F.from_json("props", "map<string,string>"))
    df = table(spark, folder, "events").select("event_id", "event_type", pairs.alias("key", "value"))
    return df.select("event_id", F.concat_ws("/", F.lit("/events"), "event_type", "key").alias("path"), "value")


PI_180 = math.pi / 180


@query("""
WITH RECURSIVE o(n, x) AS (SELECT 0, 0.0::DOUBLE UNION ALL
 SELECT n + 1, x + (a + 2 * b + 2 * c + d) / 6 FROM (SELECT n, x, a, b, c, g / pow((1 - e * e) / (1 + e * cos(x + c - p)), 2) AS d, g, e, p FROM
  (SELECT *, g / pow((1 - e * e) / (1 + e * cos(x + b / 2 - p)), 2) AS c FROM (SELECT *, g / pow((1 - e * e) / (1 + e * cos(x + a / 2 - p)), 2) AS b FROM
   (SELECT *, g / pow((1 - e * e) / (1 + e * cos(x - p)), 2) AS a FROM
    (SELECT n, x, 0.01671::DOUBLE AS e, radians(102.932) AS p, 2 * pi() / 36 * sqrt(1 - 0.01671::DOUBLE * 0.01671::DOUBLE) AS g FROM o WHERE n < 35)))))),
l AS (SELECT c_custkey, radians(c_custkey % 179 - 89) AS lat FROM customer),
d AS (SELECT l.*, x, asin(-sin(radians(23.439)) * sin(x)) AS dec FROM l, o),
h AS (SELECT *, CASE WHEN -tan(lat) * tan(dec) >= 1 THEN 0 WHEN -tan(lat) * tan(dec) <= -1 THEN pi() ELSE acos(-tan(lat) * tan(dec)) END AS h FROM d)
SELECT c_custkey, round(sum(CASE WHEN h = 0 THEN 0 ELSE greatest(0, sin(lat) * sin(dec) + cos(lat) * cos(dec) * sin(h) / h) END * h / pi()
 * pow((1 + 0.01671 * cos(x - radians(102.932))) / (1 - 0.01671 * 0.01671), 2)) / 36, 7) AS solar FROM h GROUP BY c_custkey""")
def annual_solar(spark, folder):
    lat = table(spark, folder, "customer").select("c_custkey", F.radians(F.col("c_custkey") % 179 - 89).alias("lat"))
    return ph.annual_mean_solar(lat, "lat", 36).select("c_custkey", F.round("solar", 7).alias("solar"))


@query()
def surface_drag(spark, folder):
    air = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", (280 + F.col("l_quantity") / 2).alias("pt"), F.lit(292.0).alias("pt0"), F.lit(30.0).alias("z"),
        F.lit(0.05).alias("z0"), F.lit(0.01).alias("zt"), (1 + F.col("l_discount") * 100).alias("speed"),
    )
    return ph.surface_drag(air).select("l_orderkey", "l_linenumber", "drag_m", "drag_t", "u_star", "b_star")
