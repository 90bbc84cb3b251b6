"""Missing corners, months between years, vapour tables, gathering, gas fluxes."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import vapour
from tidemark.operators import regrid
from tidemark.operators.climatology import climatology, months_between_years
from tidemark.operators.fields import Override, override_from
from tidemark.operators.gas_flux import Flux, fluxes, register
from tidemark.operators.halo import across_edges, cube_contacts
from tidemark.operators.mosaic import find_contacts, tile_gradient
from tidemark.sources import gathering, store


def near(corners, x, y):
    """By the picture: the point's quadrant, its corner, two middles of sides and the middle of the cell."""
    points = {(a, b): v for (a, b), v in zip([(0, 0), (1, 0), (0, 1), (1, 1)], corners)}
    left = [v for v in corners if v is not None]
    if len(left) == 4:
        return sum(v * (x if a else 1 - x) * (y if b else 1 - y) for (a, b), v in points.items())
    ties = [(a, b) for a in ((0, 1) if x == 0.5 else (int(x > 0.5),)) for b in ((0, 1) if y == 0.5 else (int(y > 0.5),))]
    if not left or any(points[t] is None for t in ties):
        return None
    a, b = int(x > 0.5), int(y > 0.5)
    if len(left) == 3:
        diagonals = [(points[0, 0], points[1, 1]), (points[1, 0], points[0, 1])]
        middle = next(sum(d) / 2 for d in diagonals if None not in d)
    else:
        middle = sum(left) / len(left)
    own = points[a, b]
    side = lambda o: own if o is None else (own + o) / 2
    p, q = 2 * (x if a else 1 - x) - 1, 2 * (y if b else 1 - y) - 1
    return p * q * own + (1 - p) * q * side(points[1 - a, b]) + p * (1 - q) * side(points[a, 1 - b]) + (1 - p) * (1 - q) * middle


def test_all_masks_of_a_cell(spark):
    masks = list(itertools.product([True, False], repeat=4))
    cells = [(2 * m + a, b, 1.0 + 2 * a + 5 * b + a * b) for m, mask in enumerate(masks) for (a, b), on in zip([(0, 0), (1, 0), (0, 1), (1, 1)], mask) if on]
    field = spark.createDataFrame(cells, "i int, j int, v double")
    spots = [(x, y) for x in (0.0, 0.2, 0.5, 0.7, 1.0) for y in (0.0, 0.3, 0.5, 0.9)]
    points = [(m * 100 + n, 2 * m + x, y) for m in range(16) for n, (x, y) in enumerate(spots) if x < 1.0 or m == 15]
    df = spark.createDataFrame([(d, float(x), float(y)) for d, x, y in points], "dst long, x double, y double")
    got = {r.dst: r.value for r in regrid.bilinear_near(field, df, [float(i) for i in range(32)], [0.0, 1.0], "v").collect()}
    assert len(got) == len(points)
    for m, mask in enumerate(masks):
        corners = [1.0 + 2 * a + 5 * b + a * b if on else None for (a, b), on in zip([(0, 0), (1, 0), (0, 1), (1, 1)], mask)]
        for n, (x, y) in enumerate(spots):
            if m * 100 + n in got:
                want = near(corners, x, y)
                assert got[m * 100 + n] == (None if want is None else pytest.approx(want)), (mask, x, y)


def test_months_between_years(spark):
    source = [(y, m, 15, 1, float(y * 100 + m)) for y in (1960, 1970) for m in range(1, 13)]
    source += [(y, m, 15, 2, None if (y, m) == (1970, 3) else 0.0) for y in (1960, 1970) for m in range(1, 13)]
    df = spark.createDataFrame(source, "year int, month int, day int, c int, x double")
    times = ["1960-03-15", "1960-03-31 12:00:00", "1965-03-15", "1965-03-20", "1964-12-31", "1970-12-15", "1970-12-16", "1960-01-14", "1961-01-01"]
    t = spark.createDataFrame([(x,) for x in times], "t string").select(F.col("t").cast("timestamp").alias("t"))
    got = {(str(r.t)[:16], r.c): r.x for r in months_between_years(df, t, ["c"]).collect()}
    day = lambda a: np.datetime64(a).astype("datetime64[s]").astype(float)

    def month(y, m):
        """The month's value at its own year."""
        low, high = (1960, 1970) if 1960 <= y <= 1970 else (y, y)
        if y in (1960, 1970):
            return y * 100 + m
        w = (day(f"{y}-{m:02}-15") - day(f"{low}-{m:02}-15")) / (day(f"{high}-{m:02}-15") - day(f"{low}-{m:02}-15"))
        return (1 - w) * (low * 100 + m) + w * (high * 100 + m)

    assert got["1960-03-15 00:00", 1] == 196003.0 and got["1960-03-31 12:00", 1] == pytest.approx(196003 + 16.5 / 31)
    assert got["1965-03-15 00:00", 1] == pytest.approx(month(1965, 3))
    w = 5 / 31
    assert got["1965-03-20 00:00", 1] == pytest.approx((1 - w) * month(1965, 3) + w * month(1965, 4))
    w = 16 / 31
    assert got["1964-12-31 00:00", 1] == pytest.approx((1 - w) * month(1964, 12) + w * month(1965, 1))
    assert got["1961-01-01 00:00", 1] == pytest.approx((1 - 17 / 31) * 196012 + 17 / 31 * month(1961, 1))
    assert got["1970-12-15 00:00", 1] == 197012.0 and ("1970-12-16 00:00", 1) not in got and ("1960-01-14 00:00", 1) not in got
    assert got["1965-03-15 00:00", 2] is None and got["1960-03-15 00:00", 2] == 0.0
    assert months_between_years(df.limit(0), t, ["c"]).collect() == []
    with pytest.raises(ValueError, match="one slice a month"):
        months_between_years(df.where("month < 12"), t, ["c"])


def test_a_null_record_is_missing_between(spark):
    slices = spark.createDataFrame([(t, i, j, None if (t, i) == (6.0, 0) else 10.0) for t in (0.0, 6.0) for i in (0, 1) for j in (0, 1)], "t double, i int, j int, x double")
    model = spark.createDataFrame([(k, 3.0, x, 0.5, -1.0) for k, x in enumerate((0.0, 0.5, 1.0))], "dst int, t double, lon double, lat double, x double")
    out = override_from(model, [Override("A", "x", "f")], "A", "x", "x", slices, [0.0, 1.0], [0.0, 1.0])
    assert {r.dst: r.x for r in out.collect()} == {0: None, 1: 10.0, 2: 10.0}
    source = spark.createDataFrame([(1, t, 0.0, 10.0, v) for t, v in ((0, 8.0), (10, None))] + [(2, t, 0.0, 10.0, 8.0) for t in (0, 10)], "c int, t long, top double, bottom double, q double")
    cells = spark.createDataFrame([(c, 5.0, 0, 0.0, 10.0) for c in (1, 2)], "c int, t double, k int, top double, bottom double")
    assert {r.c: r.value for r in climatology(source, cells, ["c"]).collect()} == {1: None, 2: 8.0}


def test_vapour_table_and_bad_groups(spark):
    rows = [("a", 280.0), ("a", 260.07), ("a", None), ("b", 300.0), ("b", 90.0), (None, 250.0), ("c", float("nan")), ("d", 113.16), ("d", 373.16)]
    df = spark.createDataFrame([(g, t, 9.0e4) for g, t in rows], "g string, t double, p double")
    out = vapour.saturated(df, ["g"], "t", "p", vapour.Table()).collect()
    by = {(r.g, r.t): r for r in out if r.t == r.t}
    assert len(out) == len(rows)
    for t in (280.0, 260.07):
        assert by["a", t].es == pytest.approx(float(vapour.blended(np.array(t))), rel=1e-6) and by["a", t].nbad == 0
    assert by["a", None].es is None and by["a", None].saturated is None
    assert by["b", 300.0].es == by["b", 300.0].saturated == vapour.MISSING and by["b", 90.0].nbad == 1
    assert by[None, 250.0].nbad == 0 and by[None, 250.0].es > 0 and by["d", 113.16].nbad == by["d", 373.16].nbad == 0
    slope = (float(vapour.over_water(np.array(300.01))) - float(vapour.over_water(np.array(299.99)))) / 0.02
    liquid = vapour.Table("liquid")
    assert spark.range(1).select(liquid.lookup(F.lit(300.0))[1].alias("d")).first().d == pytest.approx(slope, rel=1e-4)


def test_gathering_and_regions(spark, tmp_path):
    df = spark.range(2 * 6 * 5 * 2).select((F.col("id") % 2).alias("tile"), (F.floor(F.col("id") / 2) % 6).alias("i"), (F.floor(F.col("id") / 12) % 5).alias("j"), F.floor(F.col("id") / 60).alias("k"), (F.col("id") * 0.3).alias("x"))
    gathering.write_gathered(df, str(tmp_path / "g"), (F.col("i") + F.col("j")) % 3 != 0)
    kept = df.where("(i + j) % 3 <> 0")
    text = lambda d: sorted(map(str, d.select("tile", "i", "j", "k", "x").collect()))
    assert text(gathering.read_gathered(spark, str(tmp_path / "g"))) == text(kept)
    assert text(gathering.read_gathered(spark, str(tmp_path / "g"), where=F.col("tile") == 1)) == text(kept.where("tile = 1"))
    numbers = spark.read.parquet(str(tmp_path / "g/cells")).where("tile = 0").orderBy("j", "i").collect()
    assert [r.number for r in numbers] == list(range(len(numbers)))
    spark.read.parquet(str(tmp_path / "g/values/data")).withColumn("x", F.when((F.col("number") == 2) & (F.col("tile") == 1), F.col("x") + 1).otherwise(F.col("x"))).write.parquet(str(tmp_path / "h/values/data"))
    for part in ("cells", "values/checksums"):
        spark.read.parquet(str(tmp_path / f"g/{part}")).write.parquet(str(tmp_path / f"h/{part}"))
    with pytest.raises(ValueError, match="checksums differ: x"):
        gathering.read_gathered(spark, str(tmp_path / "h"))
    one = df.where("tile = 0 and k = 0")
    gathering.save_region(one, str(tmp_path / "r"), (1, 4, 1, 3), 1)
    back = gathering.restore_region(spark, str(tmp_path / "r"), one.withColumn("x", F.lit(-1.0)), ["tile", "i", "j", "k"])
    ring = "i between 1 and 4 and j between 1 and 3 and not (i between 2 and 3 and j = 2)"
    assert text(back.where("x >= 0")) == text(one.where(ring)) and back.count() == one.count()


def test_restart_of_reals_and_texts(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.1, "a"), (2, float("nan"), None), (3, None, "c")], "i int, x double, s string")
    store.save_restart(df, str(tmp_path / "r"), ["i", "x", "s"])
    assert store.read_restart(spark, str(tmp_path / "r")).count() == 3
    df.withColumn("x", F.col("x") + 1e-17 + 1e-16).write.mode("overwrite").parquet(str(tmp_path / "r/data"))
    with pytest.raises(ValueError, match="checksums differ: x"):
        store.read_restart(spark, str(tmp_path / "r"))


def test_gas_flux_registry(spark):
    good = Flux("a", "air_sea_gas_flux", "linear", (1.0, 2.0, 3.0, 4.0))
    assert register([good])[0].parameters == (1.0, 2.0, 3.0)
    for bad, words in (([good, good], "twice"), ([Flux("a", "air_sea_gas_flux", "no")], "undefined"), ([Flux("a", "land_sea_runoff", "river")], "1 parameters")):
        with pytest.raises(ValueError, match=words):
            register(bad)
    with pytest.raises(ValueError, match="no such flux"):
        register([good], [{"name": "b"}])
    with pytest.raises(ValueError, match="3 parameters"):
        register([Flux("a", "air_sea_gas_flux", "linear", (1.0,))], [{"name": "a", "parameters": {3: 1.0}}])
    cells = spark.createDataFrame([(1, 4.0), (2, None)], "c int, runoff double")
    out = fluxes(cells, register([Flux("r", "land_sea_runoff", "river", (2.0,), 3.0)]), ["c"]).collect()
    assert {r.c: (r.name, r.flux, r.kw) for r in out} == {1: ("r", 6.0, None), 2: ("r", None, None)}
    assert fluxes(cells, [], ["c"]).collect() == []


def test_contacts_of_a_ring_and_a_fold(spark):
    """One tile around the globe whose northern edge is folded onto itself."""
    n = 8
    rows = [(1, i, j, 2 * np.pi * i / n, -1.0 + 0.3 * j) for i in range(n + 1) for j in range(4)]
    fold = [(1, i, 4, 2 * np.pi * min(i, n - i) / n, 0.4) for i in range(n + 1)]
    corners = spark.createDataFrame([(t, i, j, float(x), float(y)) for t, i, j, x, y in rows + fold], "tile long, i long, j long, lon double, lat double")
    got = {tuple(r) for r in find_contacts(corners).collect()}
    assert (1, "N", 0, n - 1, 1, "N", 0, n - 1, True) in got
    ring = {r for r in got if r[1] != "N"}
    assert ring == {(1, "W", 0, 2, 1, "E", 0, 2, False), (1, "E", 0, 2, 1, "W", 0, 2, False)} or {r[:2] for r in ring} == {(1, "W"), (1, "E")}


def test_gradient_of_smooth_fields_on_the_cube(spark):
    from tidemark.catalogue.mosaics import cube_corners

    worst = []
    for n in (8, 16):
        corners = cube_corners(spark, n)
        at = corners.toPandas().set_index(["tile", "i", "j"])
        xyz = np.stack([np.cos(at.lat) * np.cos(at.lon), np.cos(at.lat) * np.sin(at.lon), np.sin(at.lat)], 1)
        point = {k: v for k, v in zip(at.index, xyz)}
        cells, centre = [], {}
        for t in range(1, 7):
            for i in range(n):
                for j in range(n):
                    m = sum(point[t, a, b] for a in (i, i + 1) for b in (j, j + 1))
                    centre[t, i, j] = m / np.linalg.norm(m)
                    cells.append((t, i, j, float(centre[t, i, j] @ [1.0, 2.0, 3.0]), 7.0))
        field = spark.createDataFrame(cells, "tile int, i int, j int, x double, one double")
        error = 0.0
        for r in tile_gradient(field, corners, "x").collect():
            m = centre[r.tile, r.i, r.j]
            flat = np.hypot(m[0], m[1])
            east, north = np.array([-m[1], m[0], 0]) / flat, np.array([-m[2] * m[0] / flat, -m[2] * m[1] / flat, flat])
            error = max(error, abs(r.east - east @ [1, 2, 3]), abs(r.north - north @ [1, 2, 3]))
        worst.append(error)
        if n == 8:
            flat_field = tile_gradient(field, corners, "one").agg(F.max(F.abs("east")), F.max(F.abs("north"))).first()
            assert max(flat_field) < 0.2
            contacts = find_contacts(corners).select("tile", "edge", "to_tile", "to_edge", "reverse")
            assert sorted(map(str, contacts.collect())) == sorted(map(str, cube_contacts(spark).collect()))
            assert across_edges(field.drop("one"), contacts, n, 1).count() == 24 * n
    assert worst[0] < 0.25 and worst[1] < 0.6 * worst[0]  # at the least first order, edges and corners included


def test_one_call_equals_each_operator(spark, tmp_path):
    from tidemark.operators.interpolation import interpolate, make_weights, read_weights, write_weights

    xs, ys = [0.0, 1.0, 2.5, 4.0], [0.0, 2.0, 3.0]
    grid = [(j * 4 + i, i, j, None if (i, j) == (3, 2) else float(i * i + 3 * j)) for i in range(4) for j in range(3)]
    field = spark.createDataFrame(grid, "src long, i long, j long, x double")
    points = spark.createDataFrame([(n, 0.37 * n % 4, 0.61 * n % 3) for n in range(40)], "dst long, x double, y double")
    same = lambda a, b: {r.dst: None if r[1] is None else round(r[1], 9) for r in a.collect()} == {r.dst: None if r[1] is None else round(r[1], 9) for r in b.collect()}
    own = {
        "bilinear": regrid.apply_weights(field, regrid.bilinear_weights(points, xs, ys).withColumns({"i": F.col("i") - 1, "j": F.col("j") - 1}), ["i", "j"], ["dst"], "x"),
        "bicubic": regrid.apply_weights(field, regrid.bicubic_weights(points, xs, ys).where("w <> 0"), ["i", "j"], ["dst"], "x"),
    }
    for method, want in own.items():
        weights = make_weights(method, points, axes=(xs, ys))
        write_weights(weights, str(tmp_path / method))
        got = interpolate(field.select("src", "x"), read_weights(spark, str(tmp_path / method)), "x", missing_permit=16)
        assert same(got.select("dst", "x"), want), method
    some = interpolate(field.select("src", "x"), make_weights("bicubic", points, axes=(xs, ys)), "x").where("x is null").count()
    assert 0 < some < 40
    at = spark.createDataFrame([(n, 0.1 * n, 0.05 * n) for n in range(10)], "src long, lon double, lat double")
    values = at.select("src", F.when(F.col("src") != 3, F.col("src") * 2.0).alias("x"))
    to = at.select(F.col("src").alias("dst"), (F.col("lon") + 0.02).alias("lon"), "lat")
    got = interpolate(values, make_weights("spherical", to, source=at, radius=0.3), "x")
    assert same(got.select("dst", "x"), regrid.apply_inverse_distance(values, regrid.nearest_points(at, to, 4, 0.3), "x"))
    boxes = spark.createDataFrame([(n, 10.0 * n, 10.0 * n + 10, -20.0, 20.0) for n in range(36)], "src long, lon0 double, lon1 double, lat0 double, lat1 double")
    wide = spark.createDataFrame([(n, 25.0 * n, 25.0 * n + 25, -10.0, 50.0) for n in range(14)], "dst long, lon0 double, lon1 double, lat0 double, lat1 double")
    levels = boxes.select("src", F.explode(F.array(F.lit(1), F.lit(2))).alias("k")).withColumn("x", F.when(F.col("src") % 7 != 3, F.col("src") + F.col("k")).cast("double"))
    got = interpolate(levels, make_weights("conservative", wide, source=boxes, cyclic=360.0), "x")
    for k in (1, 2):
        want = regrid.conserve_boxes(levels.where(F.col("k") == k).drop("k"), regrid.box_overlaps(boxes, wide, (10.0, 10.0)), "x")
        assert same(got.where(F.col("k") == k).select("dst", "x"), want.select("dst", "value"))
    with pytest.raises(ValueError, match="unknown method"):
        make_weights("magic", points)
    boxes.select("src", F.col("src").alias("dst"), F.lit(1.0).alias("w")).write.parquet(str(tmp_path / "plain"))
    with pytest.raises(ValueError, match="no method"):
        read_weights(spark, str(tmp_path / "plain"))


def test_bicubic_is_exact_where_differences_are(spark):
    """Parabolas along each axis with even steps; planes with any; values at the points themselves."""
    xs, ys = [float(i) for i in range(8)], [float(j) for j in range(6)]
    f = lambda x, y: float((x * x - 2 * x + 1) * (3 * y * y + y))
    field = spark.createDataFrame([(i, j, f(i, j)) for i in range(8) for j in range(6)], "i long, j long, v double")
    points = spark.createDataFrame([(n, 1 + n * 0.173 % 5, 1 + n * 0.241 % 3) for n in range(30)], "dst long, x double, y double")
    got = {r.dst: r.value for r in regrid.apply_weights(field, regrid.bicubic_weights(points, xs, ys), ["i", "j"], ["dst"], "v").collect()}
    assert all(got[r.dst] == pytest.approx(f(r.x, r.y)) for r in points.collect())
    edges = spark.createDataFrame([(0, -1.0, 2.0), (1, 9.0, 9.0), (2, 3.0, 0.0), (3, 7.0, 5.0)], "dst long, x double, y double")
    got = {r.dst: r.value for r in regrid.apply_weights(field, regrid.bicubic_weights(edges, xs, ys), ["i", "j"], ["dst"], "v").collect()}
    assert got == pytest.approx({0: f(0, 2), 1: f(7, 5), 2: f(3, 0), 3: f(7, 5)})


def test_bicubic_weights_come_from_a_row_alone(spark):
    """One row a point, however short the axes, without sums over targets; a plain field makes its weights once."""
    from tidemark.operators.interpolation import interpolate, make_weights

    def cubic(axis, v, cyclic):
        n, out = len(axis), {}
        k = max([k for k in range(n) if axis[k] <= v], default=n - 1 if cyclic else 0)
        k = k if cyclic else min(k, n - 2)
        places = [(k + d) % n for d in (-1, 0, 1, 2)] if cyclic else [max(k - 1, 0), k, k + 1, min(k + 2, n - 1)]
        at = [axis[(k + d) % n] + cyclic * ((k + d) // n) for d in (-1, 0, 1, 2)] if cyclic else [axis[m] for m in places]
        step = at[2] - at[1]
        past = (v - at[1]) % cyclic if cyclic else v - at[1]
        t = min(max(past / step, 0.0), 1.0)
        left, right = step / (at[2] - at[0]), step / (at[3] - at[1])
        h00, h10, h01, h11 = (1 + 2 * t) * (1 - t) ** 2, t * (1 - t) ** 2, t * t * (3 - 2 * t), t * t * (t - 1)
        for m, w in zip(places, (-h10 * left, h00 - h11 * right, h01 + h10 * left, h11 * right)):
            out[m] = out.get(m, 0.0) + w
        return out

    points = spark.createDataFrame([(n, 0.83 * n - 2, 0.47 * n - 1) for n in range(30)], "dst long, x double, y double").coalesce(1)
    ys = [0.0, 2.0]
    for xs, cyclic in (([0.0, 4.0], None), ([0.0, 4.0], 10.0), ([0.0, 1.0, 5.0], 10.0), ([0.0, 1.0, 5.0, 7.0, 8.0], 10.0), ([0.0, 1.0, 5.0], None)):
        weights = regrid.bicubic_weights(points, xs, ys, cyclic=cyclic)
        got = {(r.dst, r.i, r.j): r.w for r in weights.collect()}
        want = {(r.dst, i, j): a * b for r in points.collect() for i, a in cubic(xs, r.x, cyclic).items() for j, b in cubic(ys, r.y, None).items()}
        assert got == pytest.approx(want, abs=1e-12) and weights.count() == len(want)
        assert "Aggregate" not in weights._jdf.queryExecution().sparkPlan().toString()
    field = spark.createDataFrame([(n, None if n == 9 else float(n)) for n in range(10)], "src long, x double")
    out = interpolate(field, make_weights("bicubic", points, axes=([0.0, 1.0, 5.0, 7.0, 8.0], ys), cyclic=10.0), "x", target=points.select("dst").union(spark.range(90, 91)))
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("explode(") == 2 and "REPARTITION_BY_COL" in plan
    rows = {r.dst: (r.x, r.mask) for r in out.collect()}
    assert len(rows) == 31 and rows[90] == (None, 0.0)
    for r in points.collect():
        w = {j * 5 + i: a * b for i, a in cubic([0.0, 1.0, 5.0, 7.0, 8.0], r.x, 10.0).items() for j, b in cubic(ys, r.y, None).items() if a * b}
        x = None if 9 in w else sum(k * v for k, v in w.items())
        assert rows[r.dst] == (x if x is None else pytest.approx(x, abs=1e-9), pytest.approx(1 - w.get(9, 0.0), abs=1e-9))


def test_splines_with_and_without_slopes(spark):
    """A cubic comes back whole from its own slopes; natural ends have no curvature."""
    from tidemark.operators.neighbours import spline

    xs = [0.0, 0.5, 2.0, 3.0, 4.5]
    f, slope = (lambda x: x**3 - 2 * x * x + x - 1), (lambda x: 3 * x * x - 4 * x + 1)
    df = spark.createDataFrame([(1, x, f(x)) for x in xs] + [(2, 1.0, 7.0)], "c int, x double, y double")
    at = spark.createDataFrame([(c, x / 4) for c in (1, 2, 3) for x in range(0, 19)], "c int, at double")
    got = {(r.c, r.at): r.value for r in spline(df, at, ["c"], (slope(0.0), slope(4.5))).collect()}
    assert all(got[1, x / 4] == pytest.approx(f(x / 4)) and got[2, x / 4] == 7.0 and np.isnan(got[3, x / 4] or np.nan) for x in range(19))
    h = 1e-3
    ends = spark.createDataFrame([(1, x + d * h) for x in (0.0, 4.5) for d in (-1, 0, 1)], "c int, at double")
    near = sorted((r.at, r.value) for r in spline(df.where("c = 1"), ends, ["c"]).collect())
    for k in (0, 3):
        a, b, c = (v for _, v in near[k : k + 3])
        assert abs(a - 2 * b + c) / h**2 < 0.05
    with pytest.raises(Exception, match="distinct"):
        spline(df.union(df), at, ["c"]).collect()
