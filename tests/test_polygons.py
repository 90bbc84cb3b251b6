"""Polygon overlaps against boxes, sampled points and shapes known in closed form."""

from __future__ import annotations

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import polygons, regrid

SCHEMA = "{} long, lon array<double>, lat array<double>"


def cells(spark, name, rows):
    return spark.createDataFrame([(i, [float(x) for x in lon], [float(y) for y in lat]) for i, lon, lat in rows], SCHEMA.format(name))


def test_octant_and_its_parts(spark):
    octant = (0, [0, math.pi / 2, 0], [0, 0, math.pi / 2])
    half = (1, [math.pi / 4, math.pi / 2, 0], [0, 0, math.pi / 2])
    found = polygons.cell_overlaps(cells(spark, "src", [octant]), cells(spark, "dst", [octant, half]), 0.5).collect()
    assert {r.dst: r.w for r in found} == pytest.approx({0: math.pi / 2, 1: math.pi / 4})
    whole = next(r for r in found if r.dst == 0)
    assert (whole.lon, whole.lat) == pytest.approx((math.pi / 4, math.asin(1 / math.sqrt(3))))


def test_direction_of_corners_and_repeated_corners_change_nothing(spark):
    a = (0, [0.1, 0.5, 0.6, 0.2], [0.0, 0.1, 0.5, 0.4])
    turned = (1, a[1][::-1], a[2][::-1])
    again = (2, [a[1][0], *a[1], a[1][-1]], [a[2][0], *a[2], a[2][-1]])
    b = (0, [0.3, 0.9, 0.8], [0.2, 0.1, 0.7])
    for edges in ("great_circle", "lon_lat"):
        got = [r.w for r in polygons.cell_overlaps(cells(spark, "src", [a, turned, again]), cells(spark, "dst", [b, (1, b[1][::-1], b[2][::-1])]), 0.4, edges).collect()]
        assert len(got) == 6 and got == pytest.approx([got[0]] * 6)


def test_boxes_equal_the_box_operator_across_the_seam(spark):
    draw = np.random.default_rng(4)
    boxes = [(i, x, x + w, y, y + h) for i, (x, w, y, h) in enumerate(zip(draw.uniform(-400, 400, 40), draw.uniform(1, 40, 40), draw.uniform(-85, 60, 40), draw.uniform(1, 25, 40)))]
    frame = spark.createDataFrame([(i, *map(float, b)) for i, *b in boxes], "src long, lon0 double, lon1 double, lat0 double, lat1 double")
    want = {(r.src, r.dst): r.w for r in regrid.box_overlaps(frame, frame.withColumnRenamed("src", "dst"), (20.0, 20.0)).collect()}
    shapes = [(i, np.radians([a, b, b, a]), np.radians([c, c, d, d])) for i, a, b, c, d in boxes]
    got = {(r.src, r.dst): r.w for r in polygons.cell_overlaps(cells(spark, "src", shapes), cells(spark, "dst", shapes), 0.3, "lon_lat").collect()}
    small = {k for k in want if want[k] <= 2e-6 * min(want[k[0], k[0]], want[k[1], k[1]])}
    assert set(want) - small <= set(got) and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in got)


def inside(points, shape):
    """Points (n, 3) within a convex spherical polygon, anticlockwise."""
    v = polygons.unit(np.array(shape[1]), np.array(shape[2]))
    d = points @ np.cross(v, np.roll(v, -1, 0)).T
    return (d >= 0).all(1)


def test_sampled_areas(spark):
    draw = np.random.default_rng(9)
    p = draw.normal(size=(400_000, 3))
    p /= np.linalg.norm(p, axis=1, keepdims=True)

    def shape(i, n):
        """Corners on a circle of the plane that touches the sphere: convex there, so convex on the sphere."""
        m = draw.normal(size=3)
        m /= np.linalg.norm(m)
        u = np.cross(m, [0.3, 0.5, 0.8])
        u /= np.linalg.norm(u)
        turn = np.sort(draw.uniform(0, 2 * np.pi / n * 0.6, n)) + np.arange(n) * 2 * np.pi / n
        v = m + draw.uniform(0.4, 1.1) * (np.outer(np.cos(turn), u) + np.outer(np.sin(turn), np.cross(m, u)))
        return i, np.arctan2(v[:, 1], v[:, 0]), np.arctan2(v[:, 2], np.hypot(v[:, 0], v[:, 1]))

    a, b = [shape(i, 4) for i in range(6)], [shape(i, 3) for i in range(8)]
    got = {(r.src, r.dst): r.w for r in polygons.cell_overlaps(cells(spark, "src", a), cells(spark, "dst", b), 0.5).collect()}
    for x in a:
        for y in b:
            share = (inside(p, x) & inside(p, y)).mean() * 4 * np.pi
            assert got.get((x[0], y[0]), 0.0) == pytest.approx(share, abs=0.01)
    assert len(got) > 10


def test_centres_of_lon_lat_cells(spark):
    got = polygons.cell_areas(cells(spark, "c", [(0, [0, 1, 1, 0], [0.0, 0.0, 1.0, 1.0])]), "c", "lon_lat").first()
    area = math.sin(1)
    assert (got.area, got.lon, got.lat) == pytest.approx((area, 0.5, (math.cos(1) + math.sin(1) - 1) / area))


@pytest.mark.parametrize("edges", ["great_circle", "lon_lat"])
def test_narrow_cells_meet_few_others(spark, edges):
    """12000 and 16000 slivers from south to north, across the seam: each is shared whole, in seconds."""

    def ring(name, columns, rows, lean):
        n = F.col("id")
        lon = lambda a, b: (n % columns + a + lean * F.sin(F.floor(n / columns) + b)) * (2 * math.pi / columns) - 1.0
        edge = math.pi / 2 if edges == "great_circle" else 1.0
        lat = lambda b: (F.floor(n / columns) + b) * (2 * edge / rows) - edge
        at = [(0, 0), (1, 0), (1, 1), (0, 1)]
        return spark.range(columns * rows).select(n.alias(name), F.array(*[lon(a, b) for a, b in at]).alias("lon"), F.array(*[lat(b) for _, b in at]).alias("lat"))

    began = time.time()
    a, b = ring("src", 3000, 4, 0.4), ring("dst", 4000, 4, -0.7)
    met = polygons.cell_overlaps(a, b, 0.3, edges).cache()
    for name, cells_of in (("src", a), ("dst", b)):
        got = met.groupBy(name).agg(F.sum("w").alias("w")).join(polygons.cell_areas(cells_of, name, edges), name)
        assert got.where(F.abs(F.col("w") / F.col("area") - 1) < 1e-5).count() == cells_of.count()
    assert time.time() - began < 60
    met.unpersist()


def test_lon_lat_cells_are_boxed_by_all_tasks_and_pairs_added_in_place(spark):
    """Belts of most of a turn meet on both sides of the cut: one row a pair, without a shuffle by pair; cells of one file go to all tasks."""
    belt = lambda i, x, w: (i, [x + w / 2, x + w, x + w, x + w / 2, x, x], [-0.2, -0.2, 0.3, 0.3, 0.3, -0.2])
    a, b = [belt(i, 0.7 * i - 9, 5.6 + 0.1 * i) for i in range(5)], [belt(i, 1.1 * i + 2, 4.0 + 0.5 * i) for i in range(4)]
    holes = [(5, [0.0, None, 1.0], [0.0, 0.1, 0.2]), (6, None, [0.0]), (7, [0.0, 1.0, 1.0], None), (8, [], [])]
    source = cells(spark, "src", a).unionByName(spark.createDataFrame(holes, SCHEMA.format("src"))).coalesce(1)
    met = polygons.cell_overlaps(source, cells(spark, "dst", b).coalesce(1), 0.3, "lon_lat")
    got = met.collect()
    want = {}
    for i, x, _ in a:
        for j, y, _ in b:
            shared = sum(max(0.0, min(x[1] + k * 2 * math.pi, y[1]) - max(x[4] + k * 2 * math.pi, y[4])) for k in range(-5, 6))
            want[i, j] = shared * (math.sin(0.3) - math.sin(-0.2))
    assert len(got) == len(want) and {(r.src, r.dst): r.w for r in got} == pytest.approx(want)
    plan = met._jdf.queryExecution().sparkPlan().toString()
    assert "Aggregate" not in plan
    # of both sides the shuffle lies below the boxes
    assert plan.count("MapInArrow") == 3 and plan.count("RepartitionByExpression") + plan.count("REPARTITION_BY_COL") == 2


@pytest.mark.parametrize("edges", ["great_circle", "lon_lat"])
def test_slivers_count_where_sums_must_add_up(spark, edges):
    """A ten-millionth of a cell reaches into the next one: no row as it is, all of the cell if less is asked for."""
    box = lambda i, x0, x1: (i, [x0, x1, x1, x0], [-0.1, -0.1, 0.1, 0.1])
    one, two = cells(spark, "src", [box(0, 0.0, 0.1)]), cells(spark, "dst", [box(0, -0.1, 1e-8), box(1, 1e-8, 0.2)])
    assert [r.dst for r in polygons.cell_overlaps(one, two, 0.3, edges).collect()] == [1]
    got = {r.dst: r.w for r in polygons.cell_overlaps(one, two, 0.3, edges, least=1e-12).collect()}
    assert got[0] / got[1] == pytest.approx(1e-7, rel=0.05)


def test_poles_inside_on_corners_and_seams(spark):
    """Caps around both poles against wedges that end in them, with any longitude at the pole."""
    cap = lambda i, lat: (i, [0.5, 0.5 + math.pi * 2 / 3, 0.5 + math.pi * 4 / 3], [lat] * 3)
    wedge = lambda i, x, pole: (i, [2.9 + x, x, x + 0.4], [pole * math.pi / 2, pole * 0.4, pole * 0.4])
    wedges = [wedge(n, n * 0.4, 1) for n in range(15)] + [wedge(15, -0.2, -1), wedge(16, 6.2, -1)]
    caps = [cap(0, 1.2), cap(1, -1.2)]
    got = polygons.cell_overlaps(cells(spark, "src", caps), cells(spark, "dst", wedges), 0.2).collect()
    back = polygons.cell_overlaps(cells(spark, "src", wedges), cells(spark, "dst", caps), 0.2).collect()
    assert len(got) == len(back) == 17 and {(r.src, r.dst): pytest.approx(r.w) for r in got} == {(r.dst, r.src): r.w for r in back}
    whole = {r.src: r.area for r in polygons.cell_areas(cells(spark, "src", caps), "src").collect()}
    first = sum(r.w for r in got if r.src == 0)
    assert 0.9 * whole[0] < first < whole[0]  # fifteen wedges leave 2 pi - 6 open


def test_no_cells_and_cells_apart(spark):
    one, none = cells(spark, "src", [(0, [0, 0.1, 0.1], [0, 0, 0.1])]), cells(spark, "dst", [])
    assert polygons.cell_overlaps(one, none, 0.3).count() == 0
    assert polygons.cell_overlaps(one, cells(spark, "dst", [(0, [3, 3.1, 3.1], [0, 0, 0.1]), (1, [0, 0.1], [0, 0])]), 0.3).count() == 0
