"""Coverings hold their polygons, stay bounded, and decide points as counting crossings does."""

import itertools
import math
import random

import pytest

from cartolake.operators import quadtree


def star(r, lon, lat, size, n):
    ring = [(lon + size * r.uniform(0.3, 1) * math.cos(2 * math.pi * k / n), lat + size * r.uniform(0.3, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    return [*ring, ring[0]]


def inside(x, y, rings):
    return sum((a[1] > y) != (b[1] > y) and x < a[0] + (y - a[1]) / (b[1] - a[1]) * (b[0] - a[0]) for ring in rings for a, b in itertools.pairwise(ring)) % 2 == 1


@pytest.mark.parametrize("size, n", [(0.0001, 5), (0.02, 12), (3.0, 400), (60.0, 4000)])
def test_coverings(size, n):
    r = random.Random(n)
    rings = [star(r, 29.0, 20.0, size, n), star(r, 29.0, 20.0, size * 0.2, 5)]
    cells = quadtree.covering(rings)
    assert 0 < len(cells) <= quadtree.CELLS
    if size > 1:
        assert any(whole for *_, whole in cells)
    for _ in range(3000):
        x, y = 29 + size * r.uniform(-1.1, 1.1), 20 + size * r.uniform(-1.1, 1.1)
        held = [c for c in cells if c[1] == math.floor((x + 180) / 360 * 2 ** c[0]) and c[2] == math.floor((y + 90) / 180 * 2 ** c[0])]
        assert len(held) <= 1
        if inside(x, y, rings):
            assert held
        else:
            assert not held or not held[0][3]


def test_points_in_polygons(spark):
    """Large and small polygons, with holes and overlaps; points on no ground, null ones, many at one place."""
    r = random.Random(8)
    polygons = [(k, [star(r, r.uniform(-170, 170), r.uniform(-80, 80), r.choice([0.5, 5, 20]), r.randint(3, 60))]) for k in range(40)]
    polygons += [(100, [[(-180.0, -90.0), (180.0, -90.0), (180.0, 90.0), (-180.0, 90.0), (-180.0, -90.0)], star(r, 0.0, 0.0, 30.0, 9)]), (101, None), (102, [])]
    points = [(k, r.uniform(-90, 90), r.uniform(-180, 180)) for k in range(600)] + [(1000 + k, 20.0, 30.0) for k in range(200)] + [(-1, None, 1.0), (-2, 89.9, 179.9)]
    ring = "array<array<struct<lon:double,lat:double>>>"
    found = quadtree.points_in(spark.createDataFrame(points, "place int, lat double, lon double"), spark.createDataFrame(polygons, f"id int, rings {ring}"))
    wanted = {(k, i) for k, lat, lon in points if lat is not None for i, rings in polygons if rings and inside(lon, lat, rings)}
    got = [(x.place, x.found) for x in found.collect()]
    assert len(got) == len(set(got)) and set(got) == wanted and len(wanted) > 500
