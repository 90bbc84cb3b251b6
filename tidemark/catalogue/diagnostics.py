"""Reductions in time windows: events by user (six hours), line items by supplier."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from tidemark.catalogue.registry import query, table
from tidemark.functions.tables import scratch_folder
from tidemark.operators import reductions as red
from tidemark.operators import windows as win
from tidemark.operators.fields import masked
from tidemark.plans.diagnostics import output, parse_plan
from tidemark.streaming.stateful import finish_stateful, write_stateful
from tidemark.streaming.windows import read_plan

BASE = 1_704_067_200_000_000  # 2024-01-01
SIX_HOURS = 6 * 3600 * win.SECOND
END = f"({BASE} + ((epoch_us(ts) - {BASE} + {SIX_HOURS} - 1) // {SIX_HOURS}) * {SIX_HOURS})"


def events(spark, folder):
    df = table(spark, folder, "events")
    exact = F.col("value").cast("decimal(18,2)")
    return df.withColumn("us", win.micros(F.col("ts"))).withColumn("cents", exact).withColumn("window_end", win.window_end(F.col("us"), BASE, SIX_HOURS))


def _windowed(name: str, aggregate: str):
    return f"SELECT user_id, {END} AS window_end, {aggregate} AS {name} FROM events GROUP BY ALL"


@query(_windowed("last_value", "arg_max(value, ts)"))
def diag_none(spark, folder):
    return red.reduce_by(events(spark, folder), ["user_id", "window_end"], "value", "none", time="ts", name="last_value")


@query(_windowed("min_value", "min(value)"))
def diag_min(spark, folder):
    return red.reduce_by(events(spark, folder), ["user_id", "window_end"], "value", "min", name="min_value")


@query(_windowed("max_value", "max(value)"))
def diag_max(spark, folder):
    return red.reduce_by(events(spark, folder), ["user_id", "window_end"], "value", "max", name="max_value")


@query(_windowed("sum_value", "sum(value::DECIMAL(18,2))::DOUBLE"))
def diag_sum(spark, folder):
    df = red.reduce_by(events(spark, folder), ["user_id", "window_end"], "cents", "sum", name="s")
    return df.select("user_id", "window_end", F.col("s").cast("double").alias("sum_value"))


@query(_windowed("avg_value", "sum(value::DECIMAL(18,2))::DOUBLE / count(value)"))
def diag_avg(spark, folder):
    return red.reduce_by(events(spark, folder), ["user_id", "window_end"], "cents", "average", name="avg_value")


@query(_windowed("rms_value", "round(sqrt(sum(value * value) / count(value)), 6)"))
def diag_rms(spark, folder):
    df = red.reduce_by(events(spark, folder), ["user_id", "window_end"], "value", "rms", name="x")
    return df.select("user_id", "window_end", F.round("x", 6).alias("rms_value"))


@query(_windowed("avg_value", "coalesce(sum(value::DECIMAL(18,2)) FILTER (event_type <> 'error'), 0)::DOUBLE / nullif(count(*) FILTER (event_type <> 'error'), 0)"))
def diag_mask_variant(spark, folder):
    kept = masked(F.col("cents"), mask=F.col("event_type") != "error")
    return red.reduce_by(events(spark, folder).withColumn("kept", kept), ["user_id", "window_end"], "kept", "average", name="avg_value")


@query("SELECT l_suppkey, year(l_shipdate) AS y, round(sum(l_quantity * (1 - l_discount)) / sum(1 - l_discount), 6) AS avg_value FROM lineitem GROUP BY ALL")
def diag_avg_weighted(spark, folder):
    df = table(spark, folder, "lineitem").withColumn("w", 1 - F.col("l_discount")).withColumn("y", F.year("l_shipdate").cast("long"))
    df = red.reduce_by(df, ["l_suppkey", "y"], "l_quantity", "average", weight="w", name="x")
    return df.select("l_suppkey", "y", F.round("x", 6).alias("avg_value"))


@query("SELECT l_suppkey, sum(l_quantity * l_quantity * l_quantity) / count(*) AS pow3 FROM lineitem GROUP BY ALL")
def diag_pow3(spark, folder):
    return red.reduce_by(table(spark, folder, "lineitem"), ["l_suppkey"], "l_quantity", "pow3", name="pow3")


@query(f"""
WITH b AS (SELECT user_id, ((epoch_us(ts) % 86400000000) * 8 // 86400000000) + 1 AS section, sum(value::DECIMAL(18,2))::DOUBLE AS s, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, section::INTEGER AS section, s / (sum(n) OVER (PARTITION BY user_id) / 8) AS value FROM b""")
def diag_diurnal8(spark, folder):
    df = events(spark, folder).withColumn("section", win.section(F.col("us"), 8))
    return red.diurnal(df, ["user_id"], "cents", "section", 8).select("user_id", "section", "value")


CALENDAR_PLAN = """
title: calendars, clocks and regions
base_date: 1995 1 1 0 0 0
diag_files:
- file_name: monthly
  freq: 1 months
  varlist:
  - {module: shop, var_name: price, reduction: sum, output_name: total}
- file_name: yearly
  freq: 1 years
  varlist:
  - {module: shop, var_name: quantity, reduction: max, output_name: max_quantity}
- file_name: clock_daily
  freq: 1 days
  use_clock_average: true
  varlist:
  - {module: web, var_name: value, reduction: max, output_name: max_value}
- file_name: from_the_tenth
  freq: 6 hours
  start_time: 2024 1 10 0 0 0
  varlist:
  - {module: web, var_name: one, reduction: sum, output_name: n}
- file_name: region
  freq: -1
  sub_region: {grid_type: index, corner1: "3 2", corner2: "3 3", corner3: "7 2", corner4: "7 3"}
  varlist:
  - {module: shop, var_name: price, reduction: max, output_name: max_price}
- file_name: zbounds
  freq: -1
  varlist:
  - {module: shop, var_name: price, reduction: max, output_name: max_price, zbounds: 2. 4.}
  - {module: shop, var_name: one, reduction: sum, output_name: n, zbounds: 2. 4.}
- file_name: bins
  freq: 5 days
  varlist:
  - {module: web, var_name: value, reduction: diurnal4, output_name: value}
- file_name: rotating_%4yr%2mo
  freq: 1 days
  new_file_freq: 1 months
  varlist:
  - {module: shop, var_name: quantity, reduction: max, output_name: max_quantity}
"""


def _stamp(name: str):
    return F.timestamp_micros(F.col(name)).cast("timestamp_ntz").alias(name)


def _planned_orders(spark, folder, name):
    df = table(spark, folder, "orders").withColumn("name", F.lit("price")).withColumn("cents", F.col("o_totalprice").cast("decimal(18,2)"))
    # a window holds what comes after the base; the first instant of the base belongs to the window before
    plan = parse_plan(CALENDAR_PLAN.replace("1995 1 1", "1994 1 1"))
    return output(plan, name, df, "o_orderdate", ["o_custkey"], "name", "cents")


def _planned_lines(spark, folder, name, cells=("i", "j")):
    """Line items on a grid of suppliers and line numbers; each is a price and a one."""
    df = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("i"), F.col("l_linenumber").alias("j"), F.col("l_linenumber").alias("z"), "l_shipdate", "l_extendedprice")
    both = F.explode(F.array(F.struct(F.lit("price").alias("name"), F.col("l_extendedprice").alias("v")), F.struct(F.lit("one").alias("name"), F.lit(1.0).alias("v"))))
    rows = df.select("i", "j", "z", "l_shipdate", both.alias("x")).select("i", "j", "z", "l_shipdate", "x.*")
    return output(parse_plan(CALENDAR_PLAN), name, rows, "l_shipdate", list(cells), "name", "v", z="z")


@query("""
WITH e AS (SELECT 1704067200000000 + ((epoch_us(ts) - 1704067200000000 + 432000000000 - 1) // 432000000000) * 432000000000 AS window_end, event_type,
  (((epoch_us(ts) % 86400000000) * 4 // 86400000000) + 1)::INTEGER AS section, value FROM events),
b AS (SELECT window_end, event_type, section, sum(value::DECIMAL(18,2))::DOUBLE AS s, count(*) AS n FROM e GROUP BY ALL)
SELECT window_end, event_type, section, s / (sum(n) OVER (PARTITION BY window_end, event_type) / 4) AS value FROM b""")
def diag_plan_diurnal(spark, folder):
    df = table(spark, folder, "events").withColumn("name", F.lit("value")).withColumn("cents", F.col("value").cast("decimal(18,2)"))
    plan = parse_plan(CALENDAR_PLAN.replace("1995 1 1", "2024 1 1"))
    out = output(plan, "bins", df.withColumn("w", F.lit(1)), "ts", ["event_type"], "name", "cents", weight="w")
    return out.select("window_end", "event_type", "section", F.col("value").cast("double").alias("value"))


@query("""
WITH e AS (SELECT 1704067200000000 + ((epoch_us(ts) - 1704067200000000 + 432000000000 - 1) // 432000000000) * 432000000000 AS window_end, event_type,
  (((epoch_us(ts) % 86400000000) * 4 // 86400000000) + 1)::INTEGER AS section, value FROM events),
b AS (SELECT window_end, event_type, section, sum(value::DECIMAL(18,2))::DOUBLE AS s, count(*) AS n FROM e GROUP BY ALL)
SELECT window_end, event_type, section, round(s / (sum(n) OVER (PARTITION BY window_end, event_type) / 4), 6) AS value FROM b""")
def diag_stream_diurnal(spark, folder):
    """The events as a stream: sections of the day are held as state, the last window comes out of it."""
    plan = parse_plan(CALENDAR_PLAN.replace("1995 1 1", "2024 1 1"))
    shape = table(spark, folder, "events").schema
    stream = spark.readStream.schema(shape).parquet(f"{folder}/events.parque[t]").withColumn("name", F.lit("value"))
    path = f"{scratch_folder(spark)}/tidemark-stream-{uuid.uuid4().hex}"
    write_stateful(plan, "bins", stream, f"{path}/out", f"{path}/check", "ts", ["event_type"], "name", "value").awaitTermination()
    finish_stateful(plan, "bins", spark, f"{path}/out", f"{path}/check", ["event_type"])
    out = read_plan(table(spark, folder, "events"), "bins", f"{path}/out")
    return out.select("window_end", "event_type", "section", F.round("value", 6).alias("value"))


@query("""
WITH w AS (SELECT l_suppkey, (date_trunc('day', l_shipdate - INTERVAL 1 MICROSECOND) + INTERVAL 1 DAY)::TIMESTAMP AS window_end, max(l_quantity) AS max_quantity FROM lineitem GROUP BY ALL)
SELECT 'rotating_' || strftime(window_end - INTERVAL 1 MICROSECOND, '%Y%m') AS file, l_suppkey, epoch_us(window_end) AS window_end, max_quantity FROM w""")
def diag_plan_rotation(spark, folder):
    from tidemark.plans.diagnostics import file_begin

    plan = parse_plan(CALENDAR_PLAN)
    f = plan.files[-1]
    df = table(spark, folder, "lineitem").withColumn("name", F.lit("quantity"))
    out = output(plan, f.name, df, "l_shipdate", ["l_suppkey"], "name", "l_quantity")
    begin = F.timestamp_micros(file_begin(F.col("window_end"), 788_918_400_000_000, f.name_freq)).cast("timestamp_ntz")
    return out.withColumn("file", win.file_name(f.name, begin))


@query("""
WITH m AS (SELECT o_custkey, date_trunc('month', o_orderdate - INTERVAL 1 MICROSECOND) + INTERVAL 1 MONTH AS window_end, o_totalprice FROM orders)
SELECT o_custkey, window_end::TIMESTAMP AS window_end, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM m GROUP BY ALL""")
def diag_monthly(spark, folder):
    out = _planned_orders(spark, folder, "monthly")
    return out.select("o_custkey", _stamp("window_end"), F.col("total").cast("double").alias("total"))


@query("""
SELECT l_suppkey, (date_trunc('year', l_shipdate - INTERVAL 1 MICROSECOND) + INTERVAL 1 YEAR)::TIMESTAMP AS window_end, max(l_quantity) AS max_quantity FROM lineitem GROUP BY ALL""")
def diag_yearly(spark, folder):
    df = table(spark, folder, "lineitem").withColumn("name", F.lit("quantity"))
    out = output(parse_plan(CALENDAR_PLAN), "yearly", df, "l_shipdate", ["l_suppkey"], "name", "l_quantity")
    return out.select("l_suppkey", _stamp("window_end"), "max_quantity")


@query("SELECT event_type, (date_trunc('day', ts - INTERVAL 1 MICROSECOND) + INTERVAL 1 DAY)::TIMESTAMP AS window_end, max(value) AS max_value FROM events GROUP BY ALL")
def diag_clock_daily(spark, folder):
    df = table(spark, folder, "events").withColumn("name", F.lit("value"))
    out = output(parse_plan(CALENDAR_PLAN), "clock_daily", df, "ts", ["event_type"], "name", "value")
    return out.select("event_type", _stamp("window_end"), "max_value")


DAY = 86400 * win.SECOND
PHASES = [win.Phase(BASE, BASE + 5 * DAY, 6 * 3600 * win.SECOND), win.Phase(BASE + 5 * DAY, BASE + 12 * DAY, DAY), win.Phase(BASE + 12 * DAY, BASE + 40 * DAY, 5 * DAY)]


@query("""
WITH p(a, b, f) AS (VALUES {}), e AS (SELECT user_id, epoch_us(ts) AS us, value FROM events)
SELECT user_id, least(a + ((us - a + f - 1) // f) * f, b) AS window_end, min(value) AS min_value FROM e JOIN p ON us > a AND us <= b GROUP BY ALL""".format(
    ", ".join(f"({p.start}, {p.stop}, {p.freq})" for p in PHASES)))
def diag_flexible_phases(spark, folder):
    df = events(spark, folder).withColumn("window_end", win.phase_end(F.col("us"), PHASES)).where("window_end is not null")
    return df.groupBy("user_id", "window_end").agg(F.min("value").alias("min_value"))


@query(f"""
WITH w AS (SELECT {BASE} + ((epoch_us(ts) - {BASE} + {DAY} - 1) // {DAY}) * {DAY} AS window_end, value FROM events)
SELECT 'daily_' || strftime(make_timestamp(window_end - {DAY}), '%Y%m%d') AS file, window_end, max(value) AS max_value FROM w GROUP BY ALL""")
def diag_file_rotation(spark, folder):
    df = events(spark, folder).withColumn("window_end", win.window_end(F.col("us"), BASE, DAY))
    begin = F.timestamp_micros(F.col("window_end") - DAY)
    return df.groupBy("window_end").agg(F.max("value").alias("max_value")).withColumn("file", win.file_name("daily_%4yr%2mo%2dy", begin))


@query(f"SELECT DISTINCT {END} - {SIX_HOURS // 2} AS time, {END} - {SIX_HOURS} AS lower, {END} AS upper FROM events")
def diag_time_bnds(spark, folder):
    time, low, high = win.time_bounds(F.col("window_end"), SIX_HOURS)
    return events(spark, folder).select("window_end").distinct().select(time.alias("time"), low.alias("lower"), high.alias("upper"))


@query("SELECT l_suppkey, l_linenumber, max(l_extendedprice) AS max_price FROM lineitem WHERE l_suppkey BETWEEN 3 AND 7 AND l_linenumber BETWEEN 2 AND 3 GROUP BY ALL")
def diag_region(spark, folder):
    return _planned_lines(spark, folder, "region").select(F.col("i").alias("l_suppkey"), F.col("j").alias("l_linenumber"), "max_price")


@query("SELECT l_suppkey, count(*) AS n, max(l_extendedprice) AS max_price FROM lineitem WHERE l_linenumber BETWEEN 2 AND 4 GROUP BY ALL")
def diag_zbounds(spark, folder):
    out = _planned_lines(spark, folder, "zbounds", ["i"])
    return out.where("max_price is not null").select(F.col("i").alias("l_suppkey"), F.col("n").cast("long").alias("n"), "max_price")


@query(f"SELECT user_id, {END} AS window_end, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY ALL")
def diag_start_time(spark, folder):
    df = table(spark, folder, "events").withColumn("name", F.lit("one")).withColumn("one", F.lit(1.0))
    out = output(parse_plan(CALENDAR_PLAN), "from_the_tenth", df, "ts", ["user_id"], "name", "one")
    return out.select("user_id", "window_end", F.col("n").cast("long").alias("n"))


PLAN = """
title: events by user
base_date: 2024 1 1 0 0 0
diag_files:
- file_name: six_hourly
  freq: 6 hours
  varlist:
  - {module: web, var_name: click, reduction: max, output_name: click_max}
  - {module: web, var_name: purchase, reduction: min, output_name: purchase_min}
- file_name: run
  freq: -1
  varlist:
  - {module: web, var_name: click, reduction: max, output_name: click_max}
- file_name: steps
  freq: 0
  varlist:
  - {module: web, var_name: error, reduction: none, output_name: error}
"""


def _planned(spark, folder, name):
    return output(parse_plan(PLAN), name, table(spark, folder, "events"), "ts", ["user_id"], "event_type", "value")


@query(f"""
SELECT {END} AS window_end, user_id, max(value) FILTER (event_type = 'click') AS click_max, min(value) FILTER (event_type = 'purchase') AS purchase_min
FROM events WHERE event_type IN ('click', 'purchase') AND epoch_us(ts) > {BASE} GROUP BY ALL""")
def diag_plan(spark, folder):
    return _planned(spark, folder, "six_hourly")


@query("SELECT user_id, max(value) AS click_max FROM events WHERE event_type = 'click' GROUP BY ALL")
def diag_end_of_run(spark, folder):
    return _planned(spark, folder, "run").drop("window_end")


@query("SELECT epoch_us(ts) AS window_end, user_id, arg_max(value, ts) AS error FROM events WHERE event_type = 'error' GROUP BY ALL")
def diag_every_step(spark, folder):
    return _planned(spark, folder, "steps")


@query(f"""
WITH g AS (SELECT user_id, event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events)
SELECT user_id, event_id, gap FROM g WHERE gap > {DAY}""")
def diag_skipped_steps(spark, folder):
    df = events(spark, folder).select("user_id", "event_id", "us")
    return win.skipped_steps(df, ["user_id"], "us", DAY).select("user_id", "event_id", "gap")


@query("SELECT l_suppkey, round(sum(l_quantity * l_tax) / nullif(sum(l_tax), 0), 6) AS value FROM lineitem GROUP BY ALL")
def tile_average(spark, folder):
    df = red.tile_average(table(spark, folder, "lineitem"), ["l_suppkey"], "l_quantity", "l_tax")
    return df.select("l_suppkey", F.round("value", 6).alias("value"))


@query("SELECT event_id FROM events WHERE (epoch_us(ts) % 3600000000) * 2 <= 600000000 OR (3600000000 - epoch_us(ts) % 3600000000) * 2 < 600000000")
def repeat_alarm(spark, folder):
    return events(spark, folder).where(win.repeat_alarm(F.col("us"), 3600 * win.SECOND, 600 * win.SECOND)).select("event_id")


@query("SELECT event_id FROM events WHERE abs(epoch_us(ts) - 1705276800000000) * 2 <= 86400000000")
def interval_alarm(spark, folder):
    return events(spark, folder).where(win.interval_alarm(F.col("us"), DAY, F.lit(1_705_276_800_000_000))).select("event_id")


@query("""
WITH s AS (SELECT l_returnflag, sum((l_extendedprice * (1 - l_discount) * 70368744177664.0)::HUGEINT) AS u, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_returnflag, (u // 70368744177664)::BIGINT AS whole, (u % 70368744177664)::BIGINT AS fraction,
  (u // 70368744177664)::DOUBLE + (u % 70368744177664)::DOUBLE / 70368744177664.0 AS total, n FROM s""")
def efp_sum(spark, folder):
    """Values of a thousand or more have no bits below 2 ** -46, so two limbs hold the sum."""
    df = table(spark, folder, "lineitem").withColumn("x", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    out = red.exact_sum(df, ["l_returnflag"], "x", with_limbs=True)
    return out.select("l_returnflag", F.col("limb2").cast("long").alias("whole"), F.col("limb3").cast("long").alias("fraction"), "total", "n")


@query("""
SELECT user_id, bool_or(event_id % 97 = 0) OR (bool_or(event_id % 89 = 0 AND event_id % 97 <> 0) AND bool_or(event_id % 83 = 0 AND event_id % 89 <> 0 AND event_id % 97 <> 0)) AS has_nan, bool_or(event_id % 79 = 0 AND event_id % 97 <> 0 AND event_id % 89 <> 0 AND event_id % 83 <> 0) AS has_overflow,
  CASE WHEN bool_or(event_id % 97 = 0) OR (bool_or(event_id % 89 = 0 AND event_id % 97 <> 0) AND bool_or(event_id % 83 = 0 AND event_id % 89 <> 0 AND event_id % 97 <> 0)) OR bool_or(event_id % 79 = 0 AND event_id % 97 <> 0 AND event_id % 89 <> 0 AND event_id % 83 <> 0) THEN 'none'
       WHEN bool_or(event_id % 89 = 0 AND event_id % 97 <> 0) THEN 'up' WHEN bool_or(event_id % 83 = 0 AND event_id % 89 <> 0 AND event_id % 97 <> 0) THEN 'down' ELSE 'finite' END AS kind FROM events GROUP BY ALL""")
def efp_flags(spark, folder):
    """Sums of values of which some are NaN, infinite or too large."""
    n = F.col("event_id")
    x = F.when(n % 97 == 0, math.nan).when(n % 89 == 0, math.inf).when(n % 83 == 0, -math.inf).when(n % 79 == 0, 1e300).otherwise(F.col("value"))
    out = red.exact_sum(table(spark, folder, "events").withColumn("x", x), ["user_id"], "x")
    kind = F.when(F.col("total").isNull(), "none").when(F.col("total") == math.inf, "up").when(F.col("total") == -math.inf, "down").otherwise("finite")
    return out.select("user_id", "has_nan", "has_overflow", kind.alias("kind"))


@query("SELECT l_linenumber, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS total FROM lineitem GROUP BY ALL")
def global_sum(spark, folder):
    return red.global_sum(table(spark, folder, "lineitem"), ["l_linenumber"], "l_quantity", "decimal")


@query("""
WITH r AS (SELECT l_linenumber, l_extendedprice AS v, l_orderkey, l_suppkey,
  row_number() OVER (PARTITION BY l_linenumber ORDER BY l_extendedprice, l_orderkey, l_suppkey) AS a,
  row_number() OVER (PARTITION BY l_linenumber ORDER BY l_extendedprice DESC, l_orderkey, l_suppkey) AS b FROM lineitem)
SELECT l_linenumber, max(v) FILTER (a = 1) AS min_value, max(v) FILTER (b = 1) AS max_value, max(l_orderkey) FILTER (a = 1) AS min_l_orderkey,
  max(l_orderkey) FILTER (b = 1) AS max_l_orderkey, max(l_suppkey) FILTER (a = 1) AS min_l_suppkey, max(l_suppkey) FILTER (b = 1) AS max_l_suppkey FROM r GROUP BY ALL""")
def global_minmax_locus(spark, folder):
    return red.locus(table(spark, folder, "lineitem"), ["l_linenumber"], "l_extendedprice", ["l_orderkey", "l_suppkey"])


@query("""
SELECT l_suppkey, sum(l_tax::DECIMAL(18,2)) FILTER (l_returnflag <> 'R')::DOUBLE AS area, sum((l_quantity * l_tax)::DECIMAL(18,2)) FILTER (l_returnflag <> 'R')::DOUBLE AS integral,
  min(l_quantity) FILTER (l_returnflag <> 'R') AS min_value, max(l_quantity) FILTER (l_returnflag <> 'R') AS max_value, count(*) FILTER (l_returnflag = 'R') AS n_masked FROM lineitem GROUP BY ALL""")
def field_stats(spark, folder):
    df = table(spark, folder, "lineitem").withColumn("a", F.col("l_tax").cast("decimal(18,2)")).withColumn("q", F.col("l_quantity").cast("decimal(18,2)"))
    out = red.statistics(df, ["l_suppkey"], "q", "a", F.col("l_returnflag") != "R")
    return out.select("l_suppkey", *[F.col(c).cast("double") for c in ("area", "integral", "min_value", "max_value")], "n_masked")


@query("""
SELECT l_returnflag, printf('%016x', sum((l_orderkey * 4294967296 * 1024 + l_partkey)::HUGEINT) % 18446744073709551616::HUGEINT) AS chksum FROM lineitem WHERE l_partkey <> 7 GROUP BY ALL""")
def chksum_int(spark, folder):
    # from order 2 ** 21 on the integers are beyond 64 bits
    x = F.col("l_orderkey").cast("decimal(19,0)") * F.lit(1 << 42).cast("decimal(13,0)") + F.col("l_partkey")
    df = table(spark, folder, "lineitem").where("l_partkey <> 7").withColumn("x", x)
    return df.groupBy("l_returnflag").agg(red.checksum(F.col("x")).alias("chksum"))


@query("""
WITH e AS (SELECT l_returnflag, l_extendedprice AS x, floor(log2(l_extendedprice))::BIGINT AS e FROM lineitem),
b AS (SELECT l_returnflag, (e + 1023)::HUGEINT * 4503599627370496 + ((x / pow(2, e) - 1) * 4503599627370496)::HUGEINT AS bits FROM e)
SELECT l_returnflag, printf('%016x', sum(bits) % 18446744073709551616::HUGEINT) AS chksum FROM b GROUP BY ALL""")
def chksum_real(spark, folder):
    df = red.double_bits(table(spark, folder, "lineitem"), "l_extendedprice")
    return df.groupBy("l_returnflag").agg(red.checksum(F.col("bits")).alias("chksum"))


@query("SELECT l_linenumber, round(sum(l_quantity * l_tax) / (SELECT sum(l_tax) FROM lineitem), 8) AS mean FROM lineitem GROUP BY ALL")
def area_integral(spark, folder):
    out = red.area_mean(table(spark, folder, "lineitem"), ["l_linenumber"], "l_quantity", "l_tax")
    return out.select("l_linenumber", F.round("mean", 8).alias("mean"))


@query("""
WITH d AS (SELECT l_linenumber, CASE WHEN l_suppkey % 11 - 5 >= 0 THEN 1 ELSE -1 END AS hemisphere, l_quantity AS x, l_tax AS a FROM lineitem), s AS (SELECT hemisphere, sum(a) AS area FROM d GROUP BY ALL)
SELECT l_linenumber, hemisphere, round(sum(x * a) / any_value(area), 8) AS mean FROM d JOIN s USING (hemisphere) GROUP BY ALL""")
def hemispheric_integral(spark, folder):
    df = table(spark, folder, "lineitem").withColumn("lat", F.col("l_suppkey") % 11 - 5)
    out = red.area_mean(df, ["l_linenumber"], "l_quantity", "l_tax", latitude="lat")
    return out.select("l_linenumber", "hemisphere", F.round("mean", 8).alias("mean"))


@query("SELECT user_id % 5 AS g, count(*) AS calls, round(sum(value * (user_id + 1)) / sum(user_id + 1), 6) AS average FROM events GROUP BY ALL")
def integral_average(spark, folder):
    df = table(spark, folder, "events").withColumn("g", F.col("user_id") % 5).withColumn("a", (F.col("user_id") + 1).cast("double"))
    return red.integral_average(df, ["g"], "value", "a", 1).select("g", "calls", F.round("average", 6).alias("average"))


@query("SELECT l_suppkey, l_orderkey % 10 AS j, round(sum(l_quantity * l_discount) / nullif(sum(l_discount), 0), 6) AS mean FROM lineitem GROUP BY ALL")
def vertical_mean(spark, folder):
    df = table(spark, folder, "lineitem").withColumn("j", F.col("l_orderkey") % 10)
    return red.weighted_mean(df, ["l_suppkey", "j"], "l_quantity", "l_discount").select("l_suppkey", "j", F.round("mean", 6).alias("mean"))
