"""Outlines against brute force: cutting keeps areas, unions keep cells, thinning equals the recursive rule."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lintel.operators import geometry as G

RING = "area_id long, ring array<struct<x: double, y: double>>"


def made(spark, *rings):
    return spark.createDataFrame([(k, [(float(x), float(y)) for x, y in (*r, r[0])]) for k, r in rings], RING)


def star(n, seed, reach=1000):
    rng = random.Random(seed)
    at = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return [(round(reach * (1 + i % 2 * 2) * math.cos(a)), round(reach * (1 + i % 2 * 2) * math.sin(a))) for i, a in enumerate(at)]


def twice(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False))


def points_of(row):
    return [(p["x"], p["y"]) for p in row["ring"]]


@pytest.mark.parametrize("most", [30])
def test_parts_add_up(spark, most):
    rings = [(1, star(120, 1)), (2, star(7, 2)), (3, [(0, 0), (9, 0), (9, 9)]), (4, list(reversed(star(40, 3))))]
    parts = [(r["area_id"], points_of(r)) for r in G.subdivided(made(spark, *rings), "area_id", most).collect()]
    wide = lambda p: max(max(x) - min(x) for x in zip(*p, strict=True))
    assert all(p[0] == p[-1] and (len(p) - 1 <= most or wide(p) <= 2) for _, p in parts)
    for key, ring in rings:
        assert sum(twice(p) for k, p in parts if k == key) == pytest.approx(twice([*ring, ring[0]]), rel=1e-9)


def test_a_ring_is_cut_in_many_tasks(spark):
    """All rings came from one task's file, and were cut in that task to the end."""
    from pyspark.sql.functions import spark_partition_id

    parts = G.subdivided(made(spark, (1, star(900, 7, 100_000))), "area_id", 12)
    large = parts.select(F.input_file_name().alias("file"), (F.size("ring") - 1).alias("n"))
    assert large.agg(F.max("n")).first()[0] <= 12
    assert large.select("file").distinct().count() >= 2 * spark.sparkContext.defaultParallelism
    assert parts.select(spark_partition_id()).distinct().count() > 1


def test_points_in_parts_equal_points_in_rings(spark):
    from lintel.operators.spatial import inside

    rng = random.Random(4)
    rings = made(spark, (1, star(120, 5)), (2, [(x + 2000, y) for x, y in star(90, 6)]))
    points = spark.createDataFrame([(i, float(rng.randint(-3500, 5500)), float(rng.randint(-3500, 3500))) for i in range(600)], "p long, x double, y double")
    whole = {tuple(r) for r in inside(points, rings, "p", "area_id", 2000).collect()}
    assert {tuple(r) for r in G.inside_parts(points, G.subdivided(rings, "area_id", 10), "p", "area_id", 700).collect()} == whole
    assert 50 < len(whole) < 600


def holds(closed, x, y):
    """Even and odd crossings of a level ray; on a side is inside."""
    crossed = False
    for (ax, ay), (bx, by) in zip(closed, closed[1:], strict=False):
        if (bx - ax) * (y - ay) == (by - ay) * (x - ax) and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return True
        crossed ^= (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax
    return crossed


def test_points_in_sectors_equal_points_in_rings(spark):
    """Spikes, a turned ring, a spiral that a ray from its middle meets often, a ring whose middle is outside, sides through the middle; points on corners, sides and outside."""
    rng = random.Random(5)
    bow = [(0, 0), (101, 101), (101, 0), (0, 101)]
    moon = [(0, 0), (400, 0), (400, 40), (40, 40), (40, 400), (0, 400)]
    spiral = [(round(r * math.cos(t / 5)), round(r * math.sin(t / 5))) for r, t in ((20 + 6 * t, t) for t in range(90))]
    band = spiral + [(round(x * 0.93), round(y * 0.93)) for x, y in reversed(spiral)]
    shapes = [(1, star(120, 5)), (2, [(x + 2000, y) for x, y in reversed(star(90, 6))]), (3, bow), (4, [(x - 300, y) for x, y in moon]), (5, band), (6, square(-50, -50, 100)), (6, square(900, 900, 3))]
    corners = [p for _, r in shapes for p in r[:20]]
    spots = corners + [(50, 50), (0, 0), (-50, 10), (10, 50), (-100, 0), (901, 900)] + [(rng.randint(-3500, 5500), rng.randint(-3500, 3500)) for _ in range(500)] + [(rng.randint(-450, 450), rng.randint(-450, 450)) for _ in range(400)]
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate([*spots, *spots[:5]])], "p long, x double, y double")
    points = points.unionByName(points.limit(9))  # rows filed twice
    rings = made(spark, *shapes)
    held = {(i, k) for i, p in enumerate([*spots, *spots[:5]]) for k, r in shapes if holds([*r, r[0]], *p)}
    assert {k for _, k in held} == set(range(1, 7))
    for keys in (range(1, 7), (3, 6), (4,), (5,)):
        whole = {(i, min(k for j, k in held if j == i and k in keys)) for i in {i for i, k in held if k in keys}}
        assert {tuple(r) for r in G.inside_sectors(points, rings.filter(F.col("area_id").isin(*keys)), "p", "area_id", 700).collect()} == whole
    assert G.inside_sectors(points, rings.limit(0), "p", "area_id", 700).count() == 0


def test_ring_of_spikes_meets_few_sides(spark):
    """Three thousand spikes and as many points: by parts of the ring this took minutes."""
    ring = [(round(400_000 * (1 + i % 2) * math.cos(i * math.pi / 1500)), round(400_000 * (1 + i % 2) * math.sin(i * math.pi / 1500))) for i in range(3000)]
    rng = random.Random(6)
    spots = [(i, rng.randint(-800_000, 800_000), rng.randint(-800_000, 800_000)) for i in range(3000)]
    points = spark.createDataFrame([(i, float(x), float(y)) for i, x, y in spots], "p long, x double, y double")
    want = {i for i, x, y in spots if holds([*ring, ring[0]], x, y)}
    assert {r["p"] for r in G.inside_sectors(points, made(spark, (1, ring)), "p", "area_id", 300_000).collect()} == want


def test_ring_of_one_place(spark):
    """Corners that no line can part stay together."""
    ring = [(5, 5), (6, 5), (6, 6)] * 10
    assert [len(points_of(r)) for r in G.subdivided(made(spark, (1, ring)), "area_id", 4).collect()] == [31]
    assert G.subdivided(made(spark, (1, ring)).limit(0), "area_id").count() == 0


def square(x, y, side=1, back=False):
    ring = [(x, y), (x + side, y), (x + side, y + side), (x, y + side)]
    return ring[::-1] if back else ring


def covered_cells(rings, size=12):
    """Unit cells inside by even and odd crossings of all rings."""
    out = set()
    for i in range(size):
        for j in range(size):
            x, y = i + 0.5, j + 0.5
            hits = sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for r in rings for a, b in zip(r, r[1:], strict=False))
            if hits % 2:
                out.add((i, j))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_union_of_squares(spark, seed):
    """Squares of two sizes that share sides, halves of sides, corners or nothing, and enclose holes."""
    rng, cells, rings = random.Random(seed), set(), []
    for _ in range(60):
        side = rng.choice((1, 1, 2, 3))
        x, y = rng.randint(0, 9), rng.randint(0, 9)
        mine = {(x + a, y + b) for a in range(side) for b in range(side)}
        if not mine & cells:
            cells |= mine
            rings.append((7, square(x, y, side, rng.random() < 0.5)))
    found = [points_of(r) for r in G.united(made(spark, *rings), "area_id", 2).collect()]
    assert covered_cells(found) == cells
    assert sum(map(twice, found)) == 2 * len(cells)
    assert all(r[0] == r[-1] and min(r) == r[0] for r in found)


def test_union_shapes(spark):
    frame = [(1, square(x, y)) for x in range(3) for y in range(3) if (x, y) != (1, 1)]
    touching = [(2, square(0, 0)), (2, square(1, 1))]
    island = [(3, square(0, 0)), (3, square(5, 5))]
    tee = [(4, square(0, 0, 2)), (4, square(2, 0)), (4, square(2, 1))]
    rings = G.united(made(spark, *frame, *touching, *island, *tee), "area_id", 3)
    found = {}
    for r in rings.withColumn("ring", G.straightened(F.col("ring"))).collect():
        found.setdefault(r["area_id"], []).append(twice(points_of(r)))
    assert {k: sorted(v) for k, v in found.items()} == {1: [-2, 18], 2: [2, 2], 3: [2, 2], 4: [12]}
    assert G.united(made(spark, *frame).limit(0), "area_id", 3).count() == 0
    numbers = [(r["area_id"], r["ring_no"]) for r in G.numbered_rings(rings, "area_id").collect()]
    assert sorted(numbers) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2), (4, 1)]


def thinned(points, tolerance):
    """Douglas and Peucker by recursion; a closed line's ends are one point."""
    (ax, ay), (bx, by) = points[0], points[-1]
    best, at = -1, 0
    for i, (x, y) in enumerate(points[1:-1], 1):
        long2 = (bx - ax) ** 2 + (by - ay) ** 2
        away = (x - ax) ** 2 + (y - ay) ** 2 if not long2 else ((bx - ax) * (y - ay) - (by - ay) * (x - ax)) ** 2 / long2
        if away > best:
            best, at = away, i
    if best <= tolerance**2:
        return [points[0], points[-1]]
    return thinned(points[: at + 1], tolerance)[:-1] + thinned(points[at:], tolerance)


@pytest.mark.parametrize("tolerance", [0, 30, 700, 1e6])
def test_thinning_equals_recursion(spark, tolerance):
    rng = random.Random(8)
    coast = [(round(1000 * math.cos(a / 30) + rng.gauss(0, 60)), round(1000 * math.sin(a / 30) + rng.gauss(0, 60))) for a in range(188)]
    rings = [(1, coast), (2, star(50, 9)), (3, square(0, 0, 500)), (4, [(0, 0), (50, 0), (100, 0), (100, 100)])]
    found = {r["area_id"]: points_of(r) for r in G.simplified(made(spark, *rings), "area_id", tolerance).collect()}
    for key, ring in rings:
        whole = [(float(x), float(y)) for x, y in (*ring, ring[0])]
        thin = thinned(whole, tolerance)
        assert found[key] == (thin if len(thin) >= 4 else whole)


def test_cleaning_and_centroids(spark):
    rings = made(spark, (1, [(0, 0), (0, 0), (4, 0), (4, 4), (4, 4), (0, 4)]), (2, [(0, 0), (5, 5), (0, 0)]), (3, [(1, 1)]))
    assert [(r["area_id"], points_of(r)) for r in G.cleaned(rings).collect()] == [(1, [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)])]
    holed = made(spark, (1, square(0, 0, 4)), (1, square(0, 0, 2, back=True)))
    assert [tuple(r) for r in G.centroids(holed, "area_id").collect()] == [(1, pytest.approx((2 * 16 - 1 * 4) / 12), pytest.approx((2 * 16 - 1 * 4) / 12), 12.0)]


def test_corners_of_small_parts_are_not_written(spark, monkeypatch):
    """Every part's corners were written, round by round, before its figures were worked out."""
    from lintel.plans import shapes

    rings = made(spark, *((k, star(1500, k, 100_000)) for k in (1, 2)))
    parts = G.subdivided(rings, "area_id", shapes.MOST).select("area_id", (G.box(F.col("ring"))[0] * 1000).alias("x"), (F.size("ring") - 1).alias("n"), G.twice_area(F.col("ring")).alias("a"))
    want = sorted((r["area_id"], math.floor(r["x"] + 0.5), r["n"], math.floor(r["a"] + 0.5)) for r in parts.collect())
    written, real = [], G.kept

    def counted(df, name="step"):
        out = real(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(G, "kept", counted)
    monkeypatch.setattr(shapes, "concave_rings", lambda *_: rings)
    found = sorted((r["area_id"], r["x0"], r["corners"], r["area2"]) for r in shapes.subdivided_parts(spark, "").collect())
    assert found == want
    assert sum(written) < len(found) / 4


def test_parts_in_hand_are_few(monkeypatch):
    """A ring of spikes makes parts by the square of its corners; what is held while they are cut doesn't grow so."""
    import tracemalloc

    import numpy as np

    monkeypatch.setattr(G, "LOT", 1 << 12)
    peaks, corners = [], []
    for n in (1000, 4000):
        x, y = (np.array(c, float) for c in zip(*star(n, 3, 1_000_000), strict=True))
        tracemalloc.start()
        corners.append(sum(len(lot[0]) for lot in G._parts((x, y, np.array([len(x)]), np.array([0])), 24, None)))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert corners[1] > 8 * corners[0] and peaks[1] < 3 * peaks[0] and peaks[1] < corners[1] * 16 / 2
