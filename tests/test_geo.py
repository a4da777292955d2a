import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakemason.functions.polygons import TriangleTree, disc, ear_clip, haversine_m
from lakemason.operators import geo


def area(ring):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2


def test_haversine():
    assert haversine_m(0, 0, 0, 180) == pytest.approx(math.pi * 6_371_000)
    assert haversine_m(11.5, 104.9, 11.5, 104.9) == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(0.2, 1.0), min_size=3, max_size=14), st.floats(0, 6))
def test_ear_clipping_covers_star_polygons(radii, turn):
    n = len(radii)
    ring = [(r * math.cos(turn + 2 * math.pi * i / n), r * math.sin(turn + 2 * math.pi * i / n)) for i, r in enumerate(radii)]
    parts = ear_clip(ring)
    assert sum(area(list(t)) for t in parts) == pytest.approx(area(ring), rel=1e-9)
    assert sum(area(list(t)) for t in ear_clip(ring[::-1])) == pytest.approx(area(ring), rel=1e-9)


def test_degenerate_rings():
    assert ear_clip([]) == [] and ear_clip([(0, 0), (1, 1)]) == [] and ear_clip([(0, 0), (1, 1), (2, 2)]) == []


def test_tree_against_every_triangle():
    rng = np.random.default_rng(1)
    tri = rng.random((80, 1, 2)) + rng.random((80, 3, 2)) * 0.2
    u, v = tri[:, 1] - tri[:, 0], tri[:, 2] - tri[:, 0]
    flip = u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0] < 0
    tri[flip] = tri[flip][:, ::-1]
    x, y = rng.random(500), rng.random(500)
    at, found = TriangleTree(tri).locate(x, y)
    want = {(p, t) for p in range(500) for t in range(80) if all((tri[t][(k + 1) % 3][0] - tri[t][k][0]) * (y[p] - tri[t][k][1]) - (tri[t][(k + 1) % 3][1] - tri[t][k][1]) * (x[p] - tri[t][k][0]) >= 0 for k in range(3))}
    assert set(zip(at.tolist(), found.tolist(), strict=True)) == want
    assert TriangleTree(np.empty((0, 3, 2))).locate(x, y)[0].size == 0


def test_discs_hold_their_circle():
    ring = disc(11.5, 104.9, 750)
    tree = TriangleTree(np.array(ear_clip(ring)))
    angle = np.linspace(0, 2 * math.pi, 400)
    dy = np.degrees(750 / 6_371_000) * np.sin(angle)
    dx = np.degrees(750 / 6_371_000) * np.cos(angle) / math.cos(math.radians(11.5))
    assert len(set(tree.locate(104.9 + dx, 11.5 + dy)[0].tolist())) == 400


@pytest.mark.parametrize("block", [100_000, 5])
def test_places_within_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(geo, "BLOCK_TRIANGLES", block)  # 5: the way by grid cell
    monkeypatch.setattr(geo, "CELL_POINTS", 40)
    rng = random.Random(2)
    points = [(i, 11.5 + rng.random() * 0.05, 104.9 + rng.random() * 0.05, "x") for i in range(200)]
    points += [(900, 104.92, 11.52, "swapped"), (901, None, 104.9, None), (902, 0.0, 0.0, "origin"), (903, 95.0, 200.0, "bad"), (904, float("nan"), 1.0, "nan")]
    places = [(f"p{i}", 11.5 + rng.random() * 0.05, 104.9 + rng.random() * 0.05) for i in range(12)] + [("s", 104.93, 11.53), ("none", None, None), (None, 11.5, 104.9), ("p0", 11.51, 104.91)]
    df = spark.createDataFrame(points, "id long, lat double, lon double, region string")
    sites = spark.createDataFrame(places, "name string, lat double, lon double")
    got = {(r["id"], r["place"]): r["metres"] for r in geo.places_within(df, "id", "lat", "lon", sites, "name", "lat", "lon", 750.0).collect()}
    want: dict = {}
    for i, a, b, _ in [*points[:200], (900, 11.52, 104.92, "")]:
        for n, c, d in [(n, d, c) if n == "s" else (n, c, d) for n, c, d in places if n and n != "none"]:
            m = float(haversine_m(a, b, c, d))
            if m <= 750:
                want[i, n] = min(m, want.get((i, n), 1e9))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_points_on_shared_edges_count_once(spark):
    square = [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 1.0}, {"x": 0.0, "y": 1.0}]
    beside = [{"x": p["x"] + 1, "y": p["y"]} for p in square]
    regions = spark.createDataFrame([("a", square), ("b", beside), ("n", None)], "region string, ring array<struct<x: double, y: double>>")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.0, 0.5), (3, 5.0, 5.0), (4, None, 1.0)], "id long, x double, y double")
    got = geo.points_in_regions(points, geo.triangulate(regions)).select("id", "region").collect()
    assert sorted(map(tuple, got)) == [(1, "a"), (2, "a"), (2, "b")]
    assert geo.points_in_regions(points, geo.triangulate(regions.limit(0))).count() == 0
    assert geo.points_in_regions(points.where(F.lit(False)), geo.triangulate(regions)).count() == 0
