"""Density clusters by cells and nearest places without a radius, against all pairs."""

import math
import random

import pytest

from orebody.functions.expressions import EARTH_KM
from orebody.operators import spatial


def km(a, b):
    p1, l1, p2, l2 = (math.radians(x) for x in (*a, *b))
    return 2 * EARTH_KM * math.asin(math.sqrt(min(1.0, math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin((l2 - l1) / 2) ** 2)))


def plain_clusters(points, radius, least):
    near = {i: {j for j, q in points if km(p, q) <= radius} for i, p in points}
    core = {i for i in near if len(near[i]) >= least}
    label = {i: i for i in core}
    changed = True
    while changed:
        changed = False
        for i in core:
            low = min(label[j] for j in near[i] & core)
            if low < label[i]:
                label[i], changed = low, True
    for i in near.keys() - core:
        if near[i] & core:
            label[i] = label[min(near[i] & core)]
    sizes = {}
    for c in label.values():
        sizes[c] = sizes.get(c, 0) + 1
    number = {c: n for n, c in enumerate(sorted(sizes, key=lambda c: (-sizes[c], c)))}
    return {(i, number[c], sizes[c]) for i, c in label.items()}


def scattered(seed):
    r = random.Random(seed)
    centres = [(89.5, 20.0), (-89.9, 0.0), (10.0, 179.9), (0.0, 0.0), (60.0, -100.0)]
    out = []
    for lat, long in centres:
        for _ in range(30):
            y = max(-90.0, min(90.0, lat + r.gauss(0, 0.6)))
            x = long + r.gauss(0, 0.6) / max(0.05, math.cos(math.radians(y)))
            out.append((y, (x + 180) % 360 - 180))
    out += [(r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(40)] + [(0.0, 0.0)] * 12 + [(0.01, 0.01 * k) for k in range(25)]
    return list(enumerate(out))


def frame(spark, points):
    return spark.createDataFrame([(i, *p) for i, p in points] + [(9999, None, 1.0)], "id long, lat double, long double").repartition(3)


@pytest.mark.parametrize("radius,least", [(60.0, 4), (40.0, 1)])
def test_clusters_equal_all_pairs(spark, radius, least):
    points = scattered(int(radius))
    assert {tuple(r) for r in spatial.clusters(frame(spark, points), radius, least).collect()} == plain_clusters(points, radius, least)


@pytest.mark.parametrize("tests", [0, 10**9])
def test_cells_that_only_points_can_link(spark, monkeypatch, tests):
    """Two full cells apart by about the radius: boxes of points do not decide."""
    monkeypatch.setattr(spatial, "TESTS", tests)
    r = random.Random(1)
    step = 50 / spatial.KM_PER_DEGREE
    for gap in (1.0, 1.05):
        left = [(10 + r.uniform(0, 0.2) * step, 10 + r.uniform(0, 0.2) * step) for _ in range(40)]
        right = [(10 + r.uniform(0, 0.2) * step, 10 + gap * step + r.uniform(0, 0.2) * step) for _ in range(40)]
        points = list(enumerate(left + right))
        assert {tuple(x) for x in spatial.clusters(frame(spark, points), 50.0, 5).collect()} == plain_clusters(points, 50.0, 5)


def test_a_dense_cell_writes_rows_in_proportion(spark):
    """A third of all points in one cell: no stage writes more than a few rows a point."""
    r = random.Random(2)
    sizes = {}
    for n in (500, 2000):
        points = [(k, (20 + r.uniform(0, 0.01), 20 + r.uniform(0, 0.01))) for k in range(n)] + [(n + k, (r.uniform(-60, 60), r.uniform(-170, 170))) for k in range(n)]
        kept = []
        original = spatial.settle
        spatial.settle = lambda df, label: kept.append(original(df, label)) or kept[-1]
        try:
            rows = spatial.clusters(frame(spark, points), 30.0, 4).collect()
        finally:
            spatial.settle = original
        assert max(x[2] for x in rows) >= n
        sizes[n] = max(x.count() for x in kept)
    assert sizes[2000] <= 4 * sizes[500] + 100 and sizes[2000] <= 2 * 4000


@pytest.mark.parametrize("k", [4])
def test_nearest_equal_all_pairs(spark, k):
    points = scattered(5)
    got = {}
    for r in spatial.nearest_each(frame(spark, points), k).collect():
        got.setdefault(r["place"], []).append((r["rank"], r["km"]))
    for i, p in points:
        want = sorted(km(p, q) for j, q in points if j != i)[:k]
        assert [d for _, d in sorted(got[i])] == pytest.approx(want, abs=1e-6)
    assert 9999 not in got


def test_nearest_of_few_points(spark):
    few = frame(spark, [(1, (0.0, 0.0)), (2, (0.0, 180.0)), (3, (90.0, 5.0))])
    assert len(spatial.nearest_each(few, 5).collect()) == 6
    crowd = frame(spark, [(k, (5.0, 5.0)) for k in range(200)])
    got = spatial.nearest_each(crowd, 3).collect()
    assert len(got) == 600 and {r["km"] for r in got} == {0.0}
    assert sorted(r["id"] for r in got if r["place"] == 1) == [0, 2, 3]
    assert spatial.nearest_each(few.limit(0), 2).collect() == []


def test_pairs_of_full_places_and_cells(spark, monkeypatch):
    """Places of many points and cells of many places are cut into parts, without a pair lost or doubled."""
    monkeypatch.setattr(spatial, "HELD", 4, raising=False)
    monkeypatch.setattr(spatial, "PART", 8, raising=False)
    spots = [(84.0, 10.0), (84.5, 190.0 - 360), (82.0, 100.0), (0.0, 179.9), (0.0, -179.9), (0.1, 179.5), (-3.0, 5.0)]
    rows = [(i, *spots[i * i % 7]) for i in range(90)] + [(7, 84.0, 10.5), (7, 84.0, 10.5), (200, None, 3.0)]
    df = spark.createDataFrame(rows, "id int, lat double, long double")
    pairs = spatial.near_pairs(df, 900.0, digits=3)
    known = [r for r in rows if r[1] is not None]
    want = sorted((p[0], q[0], round(km(p[1:], q[1:]), 3)) for p in known for q in known if p[0] < q[0] and km(p[1:], q[1:]) <= 900.0)
    assert sorted((r.a, r.b, r.km) for r in pairs.collect()) == want
    # a cell's parts are keys of the join: points of one cell are many tasks
    assert "part" in pairs._jdf.queryExecution().optimizedPlan().toString()
