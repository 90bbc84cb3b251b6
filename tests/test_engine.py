"""Closed forms and invariants of the engine's own operators."""

from __future__ import annotations

import datetime
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.catalogue import QUERIES
from tidemark.functions import calendar as cal
from tidemark.functions import physics as ph
from tidemark.functions.random_numbers import uniform_series
from tidemark.operators import asof, neighbours, reductions, regrid, windows
from tidemark.operators.climatology import climatology
from tidemark.plans.diagnostics import output, parse_plan
from tidemark.sources import config, store
from tidemark.streaming.windows import reduce_stream, write_parquet


def test_windows_are_closed_at_their_end(spark):
    df = spark.createDataFrame([(1,), (10,), (11,), (20,), (21,)], "t long")
    got = [r.n for r in df.select(windows.window_number(F.col("t"), 0, 10).alias("n")).collect()]
    assert got == [1, 1, 2, 2, 3]


def test_level_means_of_a_growing_field(spark):
    """Steps 1..48 of value base + step / 100, means of six: level n averages steps 6n-5..6n."""
    df = spark.range(1, 49).select((F.col("id") * 3600).alias("t"), (1000 + F.col("id") / 100).alias("value"))
    df = df.withColumn("w", windows.window_number(F.col("t"), 0, 6 * 3600))
    got = {r.w: r.value for r in reductions.reduce_by(df, ["w"], "value", "average").collect()}
    for n in range(1, 9):
        assert got[n] == pytest.approx(1000 + sum(range(6 * n - 5, 6 * n + 1)) / 600)


def test_exact_sum_is_the_same_in_any_order(spark):
    rng = np.random.default_rng(3)
    x = (rng.standard_normal(5000) * 10.0 ** rng.integers(-12, 12, 5000)).tolist()
    df = spark.createDataFrame([(v,) for v in x], "x double")
    got = {reductions.exact_sum(df.repartition(n), [], "x").first().total for n in (1, 3, 7)}
    assert len(got) == 1 and got.pop() == pytest.approx(math.fsum(x), rel=1e-12)
    bad = reductions.exact_sum(spark.createDataFrame([(math.nan,), (1.0,)], "x double"), [], "x").first()
    assert bad.has_nan and bad.total is None


@pytest.mark.parametrize("calendar", cal.CALENDARS)
def test_calendars_round_trip(spark, calendar):
    days = spark.range(0, 160_000, 37).select(F.col("id").alias("n"))
    y, m, d = cal.get_date(F.col("n"), calendar)
    back = days.select("n", y.alias("y"), m.alias("m"), d.alias("d")).withColumn("b", cal.set_date(F.col("y"), F.col("m"), F.col("d"), calendar))
    assert back.where("n <> b or m < 1 or m > 12 or d < 1").count() == 0
    if calendar == "gregorian":
        start = datetime.date(1, 1, 1)
        assert all((start + datetime.timedelta(r.n)) == datetime.date(r.y, r.m, r.d) for r in back.limit(500).collect())


def test_invalid_dates_are_errors(spark):
    df = spark.createDataFrame([(2001, 1, 31)], "y int, m int, d int")
    with pytest.raises(Exception, match="not a date"):
        df.select(cal.increment_months(F.col("y"), F.col("m"), F.col("d"), 1, "noleap")).collect()


def test_stream_equals_batch(spark, tables, tmp_path):
    source = spark.read.parquet(f"{tables}/events.parquet")
    source.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    out = reduce_stream(stream, "ts", ["user_id"], "value", ["min", "max", "none"], "6 hours", late="1 hour")
    write_parquet(out, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = {(r.window_end, r.user_id): (r.min, r.max, r.none) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    base, six = 1_704_067_200_000_000, 6 * 3600 * windows.SECOND
    batch = source.withColumn("window_end", windows.window_end(windows.micros(F.col("ts")), base, six)).groupBy("window_end", "user_id")
    want = {(r.window_end, r.user_id): (r.a, r.b, r.c) for r in batch.agg(F.min("value").alias("a"), F.max("value").alias("b"), F.max_by("value", "ts").alias("c")).collect()}
    last = max(k[0] for k in want)
    assert got and all(want[k] == v for k, v in got.items()) and {k for k in want if k[0] < last - six} <= set(got)


PLAN = """
title: t
base_date: 2024 1 1 0 0 0
diag_files:
- {file_name: a, freq: "1 days, 2 days", file_duration: "3 days, 4 days", varlist: [{module: m, var_name: x, reduction: pow2}]}
- {file_name: b, freq: 1 days, varlist: [{module: m, var_name: x, reduction: diurnal2}]}
"""


def test_plan(spark):
    hours = spark.range(1, 24 * 9).select(F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * 3_600_000_000).alias("t"), F.lit(1).alias("c"), F.lit("x").alias("v"), F.lit(2.0).alias("value"))
    plan = parse_plan(PLAN)
    ends = sorted(r.window_end // 86_400_000_000 - 19723 for r in output(plan, "a", hours, "t", ["c"], "v", "value").collect())
    assert ends == [1, 2, 3, 5, 7]
    assert {r.x for r in output(plan, "a", hours, "t", ["c"], "v", "value").collect()} == {4.0}
    assert {r.section for r in output(plan, "b", hours, "t", ["c"], "v", "value").collect()} == {1, 2}
    with pytest.raises(ValueError, match="unknown reduction"):
        parse_plan(PLAN.replace("pow2", "median"))


def test_file_names(spark):
    df = spark.createDataFrame([(datetime.datetime(2024, 3, 5, 7, 8, 9),)], "t timestamp_ntz")
    for template, want in (("a_%4yr%2mo%2dy%2hr", "a_2024030507"), ("%4yr_%3dy", "2024_065"), ("%4yr%2mo_%3hr", "202403_103")):
        assert df.select(windows.file_name(template, F.col("t")).alias("f")).first().f == want


def test_bilinear_reproduces_a_plane(spark):
    axis_x, axis_y = [0.0, 1.0, 2.5, 4.0], [0.0, 2.0, 3.0]
    field = spark.createDataFrame([(i + 1, j + 1, 3 * x + 2 * y) for i, x in enumerate(axis_x) for j, y in enumerate(axis_y)], "i int, j int, v double")
    points = spark.createDataFrame([(n, n * 0.39, n * 0.29) for n in range(10)], "dst int, x double, y double")
    got = regrid.apply_weights(field, regrid.bilinear_weights(points, axis_x, axis_y), ["i", "j"], ["dst"], "v")
    assert all(r.value == pytest.approx(3 * r.dst * 0.39 + 2 * r.dst * 0.29) for r in got.collect())


def test_bicubic_reproduces_a_bilinear_surface(spark):
    f = [float((i - 1) * (j - 1) + 2 * i) for j in range(4) for i in range(4)]
    got = regrid.bicubic(spark.createDataFrame([(1, f, 0.25, 0.5)], "k int, f array<double>, t double, u double"), ["k"]).first().value
    assert got == pytest.approx(0.25 * 0.5 + 2 * 1.25)


def test_conservative_regrid_keeps_the_integral(spark):
    source = spark.createDataFrame([(i, i * 10.0, i * 10.0 + 10) for i in range(36)], "src int, lo double, hi double")
    target = spark.createDataFrame([(i, i * 24.0, i * 24.0 + 24) for i in range(15)], "dst int, lo double, hi double")
    field = spark.createDataFrame([(i, float(i * i % 17)) for i in range(36)], "src int, v double")
    got = regrid.conserve(field, source, target, "v", 30.0).collect()
    assert sum(r.value * 24 for r in got) == pytest.approx(sum(i * i % 17 * 10 for i in range(36)))
    assert all(r.mask_out == pytest.approx(1) for r in got)


def test_polygon_area_of_a_box():
    box = np.radians(np.array([[0, 10], [20, 10], [20, 40], [0, 40]], float))
    assert abs(regrid.polygon_area(box)) == pytest.approx(math.radians(20) * (math.sin(math.radians(40)) - math.sin(math.radians(10))))
    assert len(regrid.clip(box, (5.0, 5.0), (6.0, 6.0))) == 0


def test_nearest_points_match_brute_force(spark):
    rng = np.random.default_rng(2)
    lon, lat = rng.uniform(0, 2 * math.pi, 150), np.arcsin(rng.uniform(-1, 1, 150))
    s = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lon[:100], lat[:100]))], "src int, lon double, lat double")
    t = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lon[100:], lat[100:]))], "dst int, lon double, lat double")
    for radius in (0.3, 1.0, 3.2):
        got = {(r.dst, r.src) for r in regrid.nearest_points(s, t, 3, radius).collect()}
        want = set()
        for d in range(50):
            c = np.sin(lat[:100]) * np.sin(lat[100 + d]) + np.cos(lat[:100]) * np.cos(lat[100 + d]) * np.cos(lon[:100] - lon[100 + d])
            a = np.arccos(np.clip(c, -1, 1))
            want |= {(d, int(i)) for i in np.argsort(a)[:3] if a[i] <= radius}
        assert got == want


def test_nearest_points_in_clusters_look_no_further_than_they_have_to(spark):
    """Sources close together, alone and at the poles; targets beside them find what brute force finds."""
    rng = np.random.default_rng(8)
    lon = np.concatenate([rng.normal(1, 0.003, 2500), rng.uniform(-9, 9, 300), [6.28, 0.01], np.linspace(0, 6, 20)])
    lat = np.concatenate([rng.normal(0.7, 0.003, 2500), np.arcsin(rng.uniform(-1, 1, 300)), [0.2, 0.2], np.full(20, math.pi / 2 - 1e-3)])
    place = "int, lon double, lat double"
    s = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lon, lat))], f"src {place}")
    at = np.r_[0:40, 2500:2560, 2800:2822]
    x, y = lon[at] + rng.normal(0, 0.01, len(at)), np.clip(lat[at] + rng.normal(0, 0.01, len(at)), -math.pi / 2, math.pi / 2)
    t = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], f"dst {place}")
    near = regrid.nearest_points(s, t, 4, 0.4)
    a = np.arccos(np.clip(np.sin(lat) * np.sin(y)[:, None] + np.cos(lat) * np.cos(y)[:, None] * np.cos(lon - x[:, None]), -1, 1))
    want = {(d, int(i)) for d in range(len(at)) for i in np.argsort(a[d], kind="stable")[:4] if a[d][i] <= 0.4}
    assert {(r.dst, r.src) for r in near.collect()} == want
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()
    many = spark.range(40_000).select(F.col("id").alias("src"), (F.col("id") * 2.399963).alias("lon"), F.asin(F.col("id") / 20_000 - 1).alias("lat"))
    began = time.time()
    found = regrid.nearest_points(many, many.withColumnRenamed("src", "dst"), 4, 0.4)
    assert found.where("rank = 1 and dst = src").count() == 40_000 and time.time() - began < 60


def test_tridiagonal_and_spline(spark):
    rng = np.random.default_rng(4)
    n = 7
    a, b, c, d = rng.uniform(0, 1, n), rng.uniform(3, 4, n), rng.uniform(0, 1, n), rng.uniform(-1, 1, n)
    df = spark.createDataFrame([(0, k, *map(float, (a[k], b[k], c[k], d[k]))) for k in range(n)], "col int, k int, a double, b double, c double, d double")
    x = np.array([r.x for r in neighbours.tridiagonal(df, ["col"]).orderBy("k").collect()])
    matrix = np.diag(b) + np.diag(a[:-1], 1) + np.diag(c[1:], -1)
    assert np.allclose(matrix @ x, d)
    points = spark.createDataFrame([(0, float(i), 2.0 * i + 1) for i in range(5)], "col int, x double, y double")
    at = spark.createDataFrame([(0, 1.3), (0, 3.75)], "col int, at double")
    assert sorted(r.value for r in neighbours.spline(points, at, ["col"]).collect()) == pytest.approx([3.6, 8.5])


def test_particles_turn_around(spark):
    cell = F.col("id")
    flow = spark.range(441).select(cell.alias("cell"), (-(cell % 21 - 10.0)).alias("u"), (F.floor(cell / 21) - 10.0).alias("v"))
    at = spark.createDataFrame([(1, 14.0, 10.0)], "id int, x double, y double")
    for _ in range(4):
        at = neighbours.push(at, [("x", "u"), ("y", "v")], [21, 21], flow, math.pi / 8)
    r = at.first()
    assert (r.x, r.y) == pytest.approx((10.0, 14.0), abs=1e-2)


def test_random_series_do_not_depend_on_partitions(spark):
    df = spark.range(20).withColumn("seed", F.col("id") + 5)
    a, b = (sorted(map(tuple, uniform_series(df.repartition(n), "id", "seed", 4).collect())) for n in (1, 6))
    assert a == b and all(0 <= x[2] <= 1 for x in a)


def test_physics_values(spark):
    r = spark.range(1).select(ph.es(F.lit(273.16)).alias("triple"), ph.es_water(F.lit(373.16)).alias("steam"), ph.stable_mix(F.lit(0.0001)).alias("mix"), ph.stable_mix(F.lit(3.0)).alias("none")).first()
    assert r.triple == pytest.approx(610.71, rel=2e-4) and r.steam == pytest.approx(101324.6)
    assert r.mix == pytest.approx(1, abs=5e-3) and r.none == 0
    table = ph.orbit_table(720)
    assert table[-1] == pytest.approx(2 * math.pi, abs=1e-6)


def test_asof_at_and_outside_references(spark):
    left = spark.createDataFrame([(1, 0), (1, 5), (1, 10), (1, 15), (2, 5)], "k int, t int")
    right = spark.createDataFrame([(1, 5, 1.0), (1, 10, 3.0)], "k int, t int, x double")
    got = {(r.k, r.t): r.interpolated for r in asof.asof_linear(left, right, ["k"], "t", "x").collect()}
    assert got == {(1, 0): None, (1, 5): 1.0, (1, 10): 3.0, (1, 15): None, (2, 5): None}


def test_store(spark, tmp_path):
    df = spark.range(100).select((F.col("id") % 10).alias("i"), F.floor(F.col("id") / 10).alias("j"), F.col("id").cast("double").alias("v"))
    path = str(tmp_path / "v")
    store.write_variable(df, path, "v", {"scale_factor": 2.0, "add_offset": 1.0, "_FillValue": 22.0})
    # raw values 12, 13, 14, 22, 23, 24: without a range a positive fill value is an upper bound
    slab = store.read_variable(spark, path, "v", {"i": 2, "j": 1}, {"i": 3, "j": 2})
    assert sorted(r.v for r in slab.where("v is not null").collect()) == [25.0, 27.0, 29.0]
    store.write_variable(df, path + "r", "v", {"_FillValue": 22.0, "valid_min": 13.0})
    slab = store.read_variable(spark, path + "r", "v", {"i": 2, "j": 1}, {"i": 3, "j": 2})
    assert sorted(r.v for r in slab.where("v is not null").collect()) == [13.0, 14.0, 23.0, 24.0]
    store.write_variable(df, path + "n", "v", {"_FillValue": -1.0, "missing_value": 13.0})
    slab = store.read_variable(spark, path + "n", "v", {"i": 2, "j": 1}, {"i": 3, "j": 2})
    assert sorted(r.v for r in slab.where("v is not null").collect()) == [12.0, 14.0, 22.0, 23.0, 24.0]
    store.save_restart(df, str(tmp_path / "r"), ["i", "j"])
    assert store.read_restart(spark, str(tmp_path / "r")).count() == 100
    df.limit(50).write.mode("overwrite").parquet(str(tmp_path / "r/data"))
    with pytest.raises(ValueError, match="checksums differ"):
        store.read_restart(spark, str(tmp_path / "r"))
    assert store.tile_path("a/b.nc", 3, 1) == "a/b.ens_01.tile3.nc"


def test_checksums_of_integers_beyond_64_bits(spark, tmp_path):
    keys = [(1 << 22, 1), (3 << 40, 2), ((1 << 63) - 1, 5), (1 << 22, 7), (-(1 << 50), 3), (None, 4)]
    rows = [(k, p, "A") for k, p in keys]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    want = sum((k << 42) + p for k, p in keys if p != 7 and k is not None) % (1 << 64)
    assert QUERIES["chksum_int"](spark, str(tmp_path)).first().chksum == f"{want:016x}"
    longs = [-(1 << 63), (1 << 63) - 1, -5, 9, 9]
    df = spark.createDataFrame([(x,) for x in longs], "x long")
    assert df.agg(reductions.checksum(F.col("x")).alias("c")).first().c == f"{sum(longs) % (1 << 64):016x}"


def test_config():
    rows = config.parse_overrides("""
data_table:
- {grid_name: ATM, fieldname_in_model: t, factor: 2.0, override_file: [{fieldname_in_file: x, file_name: f, interp_method: bilinear}], subregion: [{type: outside_region, lon_start: 1, lon_end: 2, lat_start: 3, lat_end: 4}]}
- {grid_name: LND, fieldname_in_model: q, factor: 7}
""")
    assert rows[0].outside and rows[0].region == (1.0, 2.0, 3.0, 4.0) and rows[1].source is None
    with pytest.raises(ValueError, match="unknown grid"):
        config.parse_overrides("data_table: [{grid_name: SEA, fieldname_in_model: q}]")
    tree = config.parse_field_table("field_table: [{field_type: tracer, modlist: [{model_type: atmos, varlist: [{variable: radon, units: kg, profile: [{value: fixed, surface: 1.0}]}]}]}]")
    assert tree.get("/tracer/atmos/radon/units") == "kg" and tree.get("/tracer/atmos/radon/profile/surface") == 1.0
    tree.rename("/tracer/atmos", "/tracer/land")
    assert tree.children("/tracer") == ["land"] and config.parse_values("a=1,2; b=x") == {"a": ["1", "2"], "b": ["x"]}


def test_surface_drag_solves_the_bulk_richardson_number(spark):
    rows = [(285.0, 290.0, 30.0, 0.05, 0.01, 4.0), (291.0, 290.0, 30.0, 0.05, 0.01, 6.0), (290.0, 290.0, 30.0, 0.05, 0.01, 5.0), (299.0, 290.0, 30.0, 0.05, 0.01, 0.5)]
    rows.append((290.0, 290.0, 30.0, None, 0.01, 5.0))
    df = spark.createDataFrame(rows, "pt double, pt0 double, z double, z0 double, zt double, speed double")
    unstable, stable, neutral, beyond, unknown = ph.surface_drag(df).collect()

    def integral(phi, zeta, rough):
        z = np.exp(np.linspace(math.log(rough), math.log(30.0), 20001))
        y = phi(zeta * z / 30.0)
        return float(((y[1:] + y[:-1]) / 2 * np.diff(np.log(z))).sum())

    for row, sign in ((unstable, -1), (stable, 1)):
        assert sign * row.zeta > 0
        rich = -30 * 9.80 * (row.pt0 - row.pt) / row.pt0 / (row.speed**2 + 1e-4)
        up = lambda x: 1 + x * (5 + x / 2) / (1 + x)
        fm = integral(up if sign > 0 else lambda x: (1 - 16 * x) ** -0.25, row.zeta, 0.05)
        ft = integral(up if sign > 0 else lambda x: (1 - 16 * x) ** -0.5, row.zeta, 0.01)
        assert row.zeta * ft / fm**2 == pytest.approx(rich, rel=1e-5)
        assert row.drag_m == pytest.approx((0.4 / fm) ** 2, rel=1e-5)
        assert row.drag_t == pytest.approx(0.16 / fm / ft, rel=1e-5)
        assert row.u_star == pytest.approx(0.4 / fm * row.speed, rel=1e-5)
    assert neutral.drag_m == pytest.approx((0.4 / math.log(30 / 0.05)) ** 2)
    assert unknown.drag_m is None and unknown.u_star is None
    assert beyond.zeta is None and beyond.drag_m == pytest.approx(1e-5)


def test_climatology_keeps_a_constant_and_wraps(spark):
    layers = "c long, t long, top double, bottom double, q double"
    source = spark.createDataFrame([(1, t, p, p + 10.0, float(t)) for t in (10, 20) for p in (10.0, 20.0)], layers)
    model = spark.createDataFrame([(1, t, 0, 5.0, 25.0) for t in (10, 15, 20, 25)], "c long, t long, k int, top double, bottom double")
    got = {r.t: r.value for r in climatology(source, model, ["c"]).collect()}
    assert got == pytest.approx({10: 10.0, 15: 15.0, 20: 20.0})  # 25 lies outside the slices
    got = {r.t: r.value for r in climatology(source, model, ["c"], period=20).collect()}
    assert got == pytest.approx({10: 10.0, 15: 15.0, 20: 20.0, 25: 15.0})
    got = {r.t: r.value for r in climatology(source, model, ["c"], period=20, outside="zero").collect()}
    assert got[15] == pytest.approx(15.0 * 0.75)
    got = {r.t: r.value for r in climatology(source, model, ["c"], vertical="linear").collect()}
    assert got[15] == pytest.approx(15.0)
    assert climatology(source.limit(0), model, ["c"]).count() == 0


def test_points_on_shared_edges_belong_to_the_least_cell(spark):
    corners = "cell long, " + ", ".join(f"x{i} double, y{i} double" for i in range(1, 5))
    quads = spark.createDataFrame([(n, float(n), 0.0, n + 1.0, 0.0, n + 1.0, 1.0, float(n), 1.0) for n in range(3)], corners)
    points = spark.createDataFrame([(1, 1.0, 0.5), (2, 2.5, 0.5), (3, 3.5, 0.5), (4, None, 0.5)], "dst long, x double, y double")
    assert {r.dst: r.cell for r in regrid.containing_cells(points, quads, 0.7).collect()} == {1: 0, 2: 2}



def test_daylight_is_its_integral_over_the_interval(spark):
    rows = [(la, lo, g, a, dt) for la in (-1.4, -0.3, 0.0, 0.8, 1.5) for lo in (0.0, 3.0) for g in (0.5, 5.9) for a in (0.3, 1.57, 4.7) for dt in (0.2, 3.0, 6.0)]
    df = spark.createDataFrame(rows, "lat double, lon double, gmt double, ang double, dt double")
    mean = ph.diurnal_solar(*[F.col(c) for c in df.columns[:4]], dt=F.col("dt"))
    whole = ph.diurnal_solar(*[F.col(c) for c in df.columns[:4]], dt=F.col("dt"), allow_negative=True)[0]
    for r in df.select("*", mean[0].alias("cosz"), mean[1].alias("light"), whole.alias("whole")).collect():
        dec = math.asin(-math.sin(ph.OBLIQUITY) * math.sin(r.ang))
        t = r.gmt + r.lon - math.pi + (np.arange(40_000) + 0.5) / 40_000 * r.dt
        z = math.sin(r.lat) * math.sin(dec) + math.cos(r.lat) * math.cos(dec) * np.cos(t)
        assert r.whole == pytest.approx(z.mean(), abs=1e-6)
        assert r.light == pytest.approx((z > 0).mean(), abs=2e-4)
        assert r.cosz == pytest.approx(z[z > 0].mean() if (z > 0).any() else 0.0, abs=2e-4)
    now = ph.diurnal_solar(F.lit(0.0), F.lit(0.0), F.lit(math.pi), F.lit(0.0))
    assert tuple(spark.range(1).select(*now).first()) == pytest.approx((1.0, 1.0))


def test_stability_is_solved_in_batches(spark):
    """Many rows in seconds, the same for repeated and for different rows, and null or NaN where nothing is known."""
    n = F.col("id")
    air = spark.range(300_000).select("id", (280 + n % 50 / 2).alias("pt"), F.lit(292.0).alias("pt0"), F.lit(30.0).alias("z"), F.lit(0.05).alias("z0"), F.lit(0.01).alias("zt"), (1 + n % 11).cast("double").alias("speed"))
    began = time.time()
    got = ph.surface_drag(air).agg(F.count("zeta").alias("n"), F.count_if(F.col("zeta") < 0).alias("unstable"), F.countDistinct("zeta").alias("different")).first()
    assert time.time() - began < 12 and got.different <= 550 and 0 < got.unstable < got.n < 300_000
    some = [(280.0, 30.0, 0.05), (281.0, 30.0, 0.05), (280.0, 30.0, 0.05), (None, 30.0, 0.05), (280.0, None, 0.05)]
    rows = spark.createDataFrame(some, "pt double, z double, z0 double").withColumns({"pt0": F.lit(292.0), "zt": F.lit(0.01), "speed": F.lit(3.0)}).coalesce(1)
    first, other, again, *unknown = [r.zeta for r in ph.surface_drag(rows).collect()]
    assert first == again != other and unknown[0] is None


def test_surface_layer_profile_and_neutral_drag(spark):
    args = [F.lit(x) for x in (30.0, 10.0, 2.0, 0.05, 0.01, 0.3)]
    plain = ph.wind_and_scalar_shares(*args, F.lit(0.02), neutral=True)
    calm = ph.wind_and_scalar_shares(*args[:5], F.lit(0.0), F.lit(0.02))
    want = (1 - math.log(3) / math.log(600), 1 - math.log(15) / math.log(3000))
    got = spark.range(1).select(*[c.alias(f"c{n}") for n, c in enumerate((*plain, *calm))]).first()
    assert tuple(got) == pytest.approx(want * 2)
    air = spark.createDataFrame([(285.0, 290.0, 30.0, 0.05, 0.01, 0.02, 4.0)], "pt double, pt0 double, z double, z0 double, zt double, zq double, speed double")
    row = ph.surface_drag(air, neutral=True).first()
    assert row.drag_m == pytest.approx((0.4 / math.log(600)) ** 2)
    assert row.drag_q == pytest.approx(0.16 / math.log(600) / math.log(1500))


def test_gaps_fill_from_sides_not_from_lone_corners(spark):
    nan = None
    grid = [[nan, nan, nan, nan], [nan, 4.0, nan, nan], [nan, nan, nan, nan], [nan, nan, nan, nan]]
    df = spark.createDataFrame([(i, j, x) for j, row in enumerate(grid) for i, x in enumerate(row)], "i int, j int, x double")
    once = {(r.i, r.j): r.x for r in neighbours.fill_gaps(df, [], "i", "j", "x", ((0, 3), (0, 3)), passes=1).collect()}
    assert len(once) == 16
    # (0, 1) and (1, 0) lie on the edge, where the block is cut off, and still see a side
    assert {c for c, x in once.items() if x is not None} == {(1, 1), (2, 1), (1, 2), (0, 1), (1, 0)}
    full = neighbours.fill_gaps(df, [], "i", "j", "x", ((0, 3), (0, 3)))
    assert {r.x for r in full.collect()} == {4.0}
    empty = neighbours.fill_gaps(df.where("x is null"), [], "i", "j", "x", ((0, 3), (0, 3)))
    assert empty.where("x is not null").count() == 0 and empty.count() == 15


def test_permutations_separable_grids_and_reports(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "p int, q int")
    assert {(r.p, r.q) for r in neighbours.inverse_permutation(df, [], "p", "q").collect()} == {(2, 1), (3, 2), (1, 3)}
    with pytest.raises(Exception, match="not a permutation"):
        neighbours.inverse_permutation(df.withColumn("q", F.lit(1)), [], "p", "q").collect()
    cells = spark.createDataFrame([(g, i, j, i + 0.1 * g * j, float(j)) for g in (0, 1) for i in range(3) for j in range(3)], "g int, i int, j int, lon double, lat double")
    assert {r.g: r.separable for r in regrid.is_separable(cells, ["g"]).collect()} == {0: True, 1: False}
    t = spark.createDataFrame([(1, 300.0), (1, 10.0), (1, None), (1, math.nan)], "k int, t double")
    assert ph.temperature_report(t, ["k"], "t").first().bad == 2
    clip = spark.range(1).select(ph.clip_surface(F.lit(-0.2), "ice"), ph.clip_surface(F.lit(200.0), "sst"), ph.clip_surface(F.lit(None).cast("double"), "sst")).first()
    assert tuple(clip) == (0.0, ph.ICE_CRITICAL, None)


def test_exact_sum_flags_what_it_cannot_add(spark):
    inf = math.inf
    cases = {"up": [1.0, inf], "both": [inf, -inf, 2.0], "nan": [math.nan, 1.0], "large": [1e300, 1.0], "none": [None], "some": [1e20, 1.0, -1e20, None], "small": [5e-324, 0.25]}
    df = spark.createDataFrame([(k, x) for k, xs in cases.items() for x in xs], "k string, x double")
    got = {r.k: (r.total, r.has_nan, r.has_overflow, r.n) for r in reductions.exact_sum(df, ["k"], "x").collect()}
    assert got == {
        "up": (inf, False, False, 2), "both": (None, True, False, 3), "nan": (None, True, False, 2), "large": (None, False, True, 2),
        "none": (None, False, False, 0), "some": (1.0, False, False, 3), "small": (0.25, False, False, 2),
    }


def test_stable_mix_solves_its_equation(spark):
    df = spark.createDataFrame([(r / 50,) for r in range(1, 110)], "ri double").select("ri", ph.stable_mix(F.col("ri")).alias("mix"))
    for r in df.collect():
        if r.ri >= 2:
            assert r.mix == 0
            continue
        low, high = 0.0, 1e9  # zeta / phi(zeta) rises
        for _ in range(200):
            zeta = (low + high) / 2
            phi = 1 + zeta * (5 + 0.5 * zeta) / (1 + zeta)
            low, high = (zeta, high) if zeta / phi < r.ri else (low, zeta)
        assert r.mix == pytest.approx(phi**-2, rel=1e-6, abs=1e-9)


def test_periodic_overlaps_wrap(spark):
    source = spark.createDataFrame([(1, 350.0, 370.0), (2, 0.0, 720.0)], "src int, lo double, hi double").where("src = 1")
    target = spark.createDataFrame([(1, -10.0, 10.0), (2, 365.0, 375.0), (3, 100.0, 110.0)], "dst int, lo double, hi double")
    got = {r.dst: r.w for r in regrid.overlaps(source, target, 20.0, 360.0).collect()}
    assert got == {1: pytest.approx(20.0), 2: pytest.approx(5.0)}


def test_months_and_clocks_in_plans(spark):
    text = """
title: t
base_date: 2000 1 15 6 0 0
diag_files:
- {file_name: m, freq: 2 months, new_file_freq: 1 years, varlist: [{module: a, var_name: x, reduction: max}]}
- {file_name: c, freq: 1 months, use_clock_average: true, varlist: [{module: a, var_name: x, reduction: max}]}
- {file_name: r, freq: -1, sub_region: {grid_type: latlon, corner1: 1. 2., corner2: 1. 5., corner3: 4. 2., corner4: 4. 5.}, varlist: [{module: a, var_name: x, reduction: max}]}
"""
    plan = parse_plan(text)
    assert plan.files[2].region == {"lon": (1.0, 4.0), "lat": (2.0, 5.0)}
    times = ["2000-01-15 06:00:00", "2000-01-15 06:00:01", "2000-03-15 06:00:00", "2000-03-15 06:00:01", "2000-12-31 00:00:00"]
    df = spark.createDataFrame([(t, i, float(i)) for i, t in enumerate(times)], "t string, id int, v double").withColumn("t", F.to_timestamp_ntz("t")).withColumn("n", F.lit("x"))
    stamp = F.timestamp_micros("window_end").cast("timestamp_ntz").cast("string")
    got = {r.id: r.s for r in output(plan, "m", df, "t", ["id"], "n", "v").select("id", stamp.alias("s")).collect()}
    assert got == {1: "2000-03-15 06:00:00", 2: "2000-03-15 06:00:00", 3: "2000-05-15 06:00:00", 4: "2001-01-15 06:00:00"}
    got = {r.id: r.s for r in output(plan, "c", df, "t", ["id"], "n", "v").select("id", stamp.alias("s")).collect()}
    assert got == {1: "2000-02-01 00:00:00", 2: "2000-04-01 00:00:00", 3: "2000-04-01 00:00:00", 4: "2001-01-01 00:00:00"}


def test_long_axes_plan_quickly(spark):
    import bisect
    import time

    axis = [i * 0.25 for i in range(1440)]
    df = spark.createDataFrame([(x,) for x in (0.0, 0.1, 359.9, -1.0, 400.0, 100.0)], "x double")
    began = time.time()
    low, high, w = regrid.bracket(axis, F.col("x"))
    rows = df.select("x", low.alias("low"), high.alias("high"), w.alias("w"), asof.nearest_index(F.col("x"), axis).alias("near"), asof.fractional_index(F.col("x"), axis).alias("frac")).collect()
    assert time.time() - began < 20
    for r in rows:
        at = min(max(bisect.bisect_right(axis, r.x), 1), 1440)
        assert r.low == at and r.high == (at + 1 if 0 <= r.x < axis[-1] else at)
        assert r.near == min(range(1440), key=lambda i: (abs(axis[i] - r.x), -i)) + 1
        assert r.frac == (pytest.approx(r.x * 4 + 1) if 0 <= r.x <= axis[-1] else -1)
