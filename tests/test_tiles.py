"""Halos, contacts and registries on small tables."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import halo
from tidemark.operators import registry as reg


def grid(spark, nx, ny):
    return spark.createDataFrame([(i, j, 10.0 * i + j) for i in range(nx) for j in range(ny)], "i long, j long, x double")


def test_halo_fills_corners_only_with_both_axes(spark):
    cells = grid(spark, 3, 2)
    one = halo.with_halo(cells, "i", "j", (3, 2), 1, (True, False))
    assert {(r.i, r.j) for r in one.collect()} == {(i, j) for i in range(-1, 4) for j in range(2)}
    both = {(r.i, r.j): r.x for r in halo.with_halo(cells, "i", "j", (3, 2), 1, (True, True)).collect()}
    assert len(both) == 20 and both[-1, -1] == 21.0 and both[3, 2] == 0.0


def test_halo_across_the_fold(spark):
    cells = grid(spark, 4, 3)
    out = {(r.i, r.j): r.x for r in halo.with_halo(cells, "i", "j", (4, 3), 2, (True, False), fold=True, turned=("x",)).collect()}
    assert out[0, 3] == -32.0 and out[0, 4] == -31.0 and out[4, 3] == -32.0 and out[1, 1] == 11.0
    east = {(r.i, r.j): r.x for r in halo.with_halo(cells, "i", "j", (4, 3), 1, (True, False), fold=True, position="east").collect()}
    assert east[3, 3] == 32.0 and east[0, 3] == 22.0
    north = {(r.i, r.j): r.x for r in halo.with_halo(cells, "i", "j", (4, 3), 1, (True, False), fold=True, position="north").collect()}
    assert north[0, 3] == 31.0


def test_halo_refuses_what_it_cannot_fill(spark):
    cells = grid(spark, 2, 2)
    for arguments in ({"width": 3}, {"width": 1, "fold": True}, {"width": 1, "cyclic": (True, True), "fold": True}, {"width": 1, "position": "west"}):
        with pytest.raises(ValueError):
            halo.with_halo(cells, "i", "j", (2, 2), **arguments)


def test_empty_grid_has_no_halo(spark):
    assert halo.with_halo(grid(spark, 3, 3).limit(0), "i", "j", (3, 3), 1, (True, True)).count() == 0


def test_cube_contacts_are_mutual_and_whole(spark):
    rows = {(r.tile, r.edge): (r.to_tile, r.to_edge, r.reverse) for r in halo.cube_contacts(spark).collect()}
    assert len(rows) == 24
    assert all(rows[t2, e2] == (t, e, r) for (t, e), (t2, e2, r) in rows.items())


def test_points_of_a_sphere_meet_across_the_edges_of_a_cube(spark):
    """Corner points that lie on both tiles get one value from both sides, in three dimensions."""
    n, places = 2, {}
    # each face as origin and the two axes that i and j run along, by the rule of the contacts
    faces = {1: ((1, -1, -1), (0, 1, 0), (0, 0, 1)), 2: ((1, 1, -1), (-1, 0, 0), (0, 0, 1)), 3: ((1, 1, 1), (-1, 0, 0), (0, -1, 0))}
    faces |= {4: ((-1, 1, 1), (0, 0, -1), (0, -1, 0)), 5: ((-1, -1, 1), (0, 0, -1), (1, 0, 0)), 6: ((-1, -1, -1), (0, 1, 0), (1, 0, 0))}
    for tile, (origin, a, b) in faces.items():
        for i in range(n + 1):
            for j in range(n + 1):
                places[tile, i, j] = tuple(o + i * x + j * y for o, x, y in zip(origin, a, b))
    rows = [(t, i, j, float(9 * p[0] + 3 * p[1] + p[2])) for (t, i, j), p in places.items()]
    out = halo.shared_points(spark.createDataFrame(rows, "tile long, i long, j long, x double"), halo.cube_contacts(spark), (n, n), "x").collect()
    assert len(out) == 24 * (n + 1) and all(r.x == r.across for r in out)


def test_vectors_keep_their_direction_through_a_contact(spark):
    cells = spark.createDataFrame([(1, i, j, 1.0, 2.0) for i in range(3) for j in range(3)], "tile long, i long, j long, u double, v double")
    out = halo.across_edges(cells, halo.cube_contacts(spark), 3, 1, vector=("u", "v"))
    got = {r.tile: (r.u, r.v) for r in out.collect()}
    assert got == {2: (1.0, 2.0), 3: (2.0, -1.0), 5: (-2.0, 1.0), 6: (1.0, 2.0)}


def test_names_registered_twice(spark):
    entries = spark.createDataFrame([("a", "x", 3), ("a", "y", 1), ("a", "x", 0), ("b", "y", 5)], "m string, n string, p int")
    assert {tuple(r) for r in reg.numbered(entries, "m", "n", "p").collect()} == {("a", "x", 1), ("a", "y", 2), ("b", "y", 1)}
    with pytest.raises(PySparkException, match="registered twice: x"):
        reg.numbered(entries, "m", "n", "p", strict=True).collect()


def test_conditions_with_null_types(spark):
    meta = spark.createDataFrame([(0, "gas ", True), (1, None, None), (2, "rain", False)], "bc long, flux_type string, pass_through_ice boolean")
    fields = meta.select("bc", F.lit(1).alias("field"), F.lit(1).alias("i"), F.lit(1).alias("j"), F.lit(1).alias("k"), F.lit(2.0).alias("value"))
    kept = lambda **c: sorted(r.bc for r in reg.select_fields(fields, meta, **c).collect())
    assert kept() == [0, 1, 2] and kept(exclude="gas") == [1, 2] and kept(only="gas") == [0] and kept(pass_through_ice=True) == [0]
    assert kept(bc=2, field=1) == [2] and kept(bc=2, exclude="rain") == []
    with pytest.raises(ValueError):
        reg.select_fields(fields, meta, field=1)
    assert reg.extract(fields, 2, 1, level=1, scale=3.0).first() == (1, 1, 6.0)
    changed = reg.set_field(fields, spark.createDataFrame([(1, 1, 5.0)], "i int, j int, value double"), 1, 1, level=1)
    assert sorted((r.bc, r.value) for r in changed.collect()) == [(0, 2.0), (1, 5.0), (2, 2.0)]
