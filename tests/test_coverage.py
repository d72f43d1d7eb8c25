"""Tiers of a map against sampled points and known areas."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quayside.operators import coverage, resolve

BOX = (0.0, 0.0, 10.0, 10.0)
EDGES = "iso string, ord int, ring int, x1 double, y1 double, x2 double, y2 double"


def ring(iso, ord_, number, *points):
    return [(iso, ord_, number, *map(float, a), *map(float, b)) for a, b in zip(points, [*points[1:], points[0]])]


def square(iso, ord_, x, y, size=2, number=0):
    return ring(iso, ord_, number, (x, y), (x + size, y), (x + size, y + size), (x, y + size))


def isos(spark, *codes):
    return spark.createDataFrame([(c,) for c in codes], "iso string")


def run(spark, rows, covered, reachable, box=BOX):
    return coverage.tiers(spark.createDataFrame(rows, EDGES), isos(spark, *covered), isos(spark, *reachable), box)


def holds(rings, x, y):
    """Even-odd rule over all edges."""
    return sum((r.y > y) != (r.to_y > y) and x < (r.to_x - r.x) * (y - r.y) / (r.to_y - r.y) + r.x for r in rings) % 2 == 1


def inside(rows, iso, x, y):
    hits = [r for r in rows if r[0] == iso and (r[4] > y) != (r[6] > y) and x < (r[5] - r[3]) * (y - r[4]) / (r[6] - r[4]) + r[3]]
    return len(hits) % 2 == 1


WORLD = [
    *ring("AA", 0, 0, (-3, -2), (4, -2), (4, 3), (2, 6), (-3, 6)),
    *ring("BB", 1, 0, (4, -2), (12, -2), (12, 4), (4, 3)),
    *ring("BB", 1, 1, (6, -1), (6, 2), (8, 2), (8, -1)),  # a hole, and the enclave in it
    *ring("CC", 2, 0, (6, -1), (8, -1), (8, 2), (6, 2)),
    *ring("-99", 3, 0, (4, 3), (12, 4), (13, 12), (9, 13), (5, 11), (2, 6)),
    *ring(None, 4, 0, (20, 20), (21, 20), (20, 21)),
]


@pytest.mark.parametrize("covered,reachable", [(["AA"], ["BB"]), (["BB"], ["CC", "AA"]), ([], []), (["AA", "CC"], ["AA", "-99"]), (["AA", "BB", "CC"], [])])
def test_tiers_of_countries_that_share_borders(spark, covered, reachable):
    rows = WORLD if "AA" in covered else [(i, o, n, x2, y2, x1, y1) for i, o, n, x1, y1, x2, y2 in WORLD]  # either way round
    got = run(spark, rows, covered, reachable).collect()
    r = random.Random(1)
    parts = {t: [x for x in got if x.tier == t] for t in ("light", "dark")}
    for _ in range(400):
        x, y = r.uniform(-4, 22), r.uniform(-3, 22)
        shown = 0 < x < 10 and 0 < y < 10
        own = next((i for i in ("AA", "BB", "CC", "-99", None) if inside(rows, i, x, y)), "sea")
        light = shown and own in reachable and own not in covered and own != "-99"
        dark = own != "sea" and not light and not (shown and own in covered)
        assert (holds(parts["light"], x, y), holds(parts["dark"], x, y)) == (light, dark), (x, y, own)


def test_rings_are_closed_in_order_and_shared_borders_are_gone(spark):
    rows = [e for k in range(12) for e in square(f"C{k % 5}", k, 2 * (k % 4) - 20, 2 * (k // 4))]
    got = run(spark, rows, [], []).orderBy("ring", "pos").collect()
    assert len({r.ring for r in got}) == 1 and got[0].area == 8 * 6 and len(got) == 14
    assert all((a.to_x, a.to_y) == (b.x, b.y) for a, b in zip(got, got[1:] + got[:1])) and [r.pos for r in got] == list(range(14))


def test_touching_squares_are_rings_of_their_own(spark):
    got = coverage.areas(run(spark, square("A", 0, -10, 0) + square("B", 1, -8, 2) + square("C", 2, -6, 0) + square("D", 3, -8, -2), [], [])).collect()
    assert [(r.tier, r.area, r.outer_rings + r.holes) for r in got] == [("dark", 16.0, 4)]


def test_a_long_ring_of_many_edges(spark):
    import math

    points = [(5 + 4 * math.cos(2 * math.pi * k / 3000), 5 + 4 * math.sin(2 * math.pi * k / 3000)) for k in range(3000)]
    rows = ring("A", 0, 0, *points)
    got = coverage.areas(run(spark, rows, [], ["A"], (0.0, 0.0, 10.0, 5.0))).collect()
    want = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1])) / 4
    assert {r.tier for r in got} == {"light", "dark"} and all(r.area == pytest.approx(want, rel=1e-9) and r.outer_rings == 1 for r in got)


def test_features_have_their_holes(spark):
    rows = square("A", 0, -20, 0, 6) + square("A", 0, -18, 2, 2, 1) + square("B", 1, -30, 0) + square("L", 2, 1, 1)
    got = {r.tier: json.loads(r.geometry) for r in coverage.features(run(spark, rows, [], ["L"])).collect()}
    assert list(got) == ["light", "dark"] and got["light"]["type"] == "MultiPolygon"
    assert sorted(len(p) for p in got["dark"]["coordinates"]) == [1, 2]
    outer, hole = next(p for p in got["dark"]["coordinates"] if len(p) == 2)
    assert outer[0] == outer[-1] and len(outer) == len(hole) == 5 and {tuple(p) for p in hole} == {(-18, 2), (-16, 2), (-16, 4), (-18, 4)}
    assert run(spark, rows, ["A", "B", "L"], [], (-100.0, -100.0, 100.0, 100.0)).count() == 0


def test_points_in_a_ring_of_many_edges(spark):
    import math

    points = [(3 * math.cos(2 * math.pi * k / 50_000), 3 * math.sin(2 * math.pi * k / 50_000)) for k in range(50_000)]
    edges = spark.createDataFrame(ring("A", 0, 0, *points) + square("A", 0, -1, -1, 2, 1) + square("B", 1, -2, -2, 4), EDGES)
    at = spark.range(300).select("id", (F.sin("id") * 4).alias("lon"), (F.cos(F.col("id") * 3) * 4).alias("lat"))
    got = {r.id: r.iso for r in resolve.in_polygons(at, edges).collect()}
    for r in at.collect():
        hole, square_ = max(abs(r.lon), abs(r.lat)) < 1, max(abs(r.lon), abs(r.lat)) < 2
        far = math.hypot(r.lon, r.lat)
        if abs(far - 3) > 1e-3:
            assert got.get(r.id) == ("A" if far < 3 and not hole else "B" if square_ else None), (r, far)
