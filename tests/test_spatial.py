"""Geometry against hand-computed and brute-force results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geopanel.functions import geometry as g
from geopanel.operators import spatial

L_SHAPE = [[[[0, 0], [4, 0], [4, 1], [1, 1], [1, 4], [0, 4], [0, 0]]]]
U_SHAPE = [[[[0, 0], [6, 0], [6, 5], [5, 5], [5, 1], [1, 1], [1, 5], [0, 5], [0, 0]]]]
HOLED = [[[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [3, 1], [3, 3], [1, 3], [1, 1]]]]
TRIANGLE = [[[[0, 0], [4, 0], [0, 4], [0, 0]]]]


def square(x, y, w, h=None):
    h = h or w
    return [[[[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]]]


def polys(spark, items, key="unit"):
    rows = [(k, [[[[float(v) for v in p] for p in r] for r in q] for q in m]) for k, m in items]
    return spark.createDataFrame(rows, f"{key} string, geom array<array<array<array<double>>>>")


@pytest.mark.parametrize(
    "a,b,want",
    [(L_SHAPE, square(0, 0, 2), 3.0), (L_SHAPE, TRIANGLE, 6.0), (HOLED, square(0, 0, 2), 3.0), (HOLED, square(1, 1, 2), 0.0), (U_SHAPE, square(2, 0.5, 1, 9), 0.5), (TRIANGLE, TRIANGLE, 8.0), (square(0, 0, 1), square(5, 5, 1), 0.0)],
)
def test_intersection_areas(a, b, want):
    assert spatial.intersection_area(a, b) == pytest.approx(want, abs=1e-9)
    assert spatial.intersection_area(b, a) == pytest.approx(want, abs=1e-9)


def test_overlay_adds_up_over_a_partition(spark):
    tiles = [(f"{i},{j}", square(i * 0.7, j * 0.7, 0.7)) for i in range(9) for j in range(9)]
    shapes = [("L", L_SHAPE), ("U", U_SHAPE), ("T", TRIANGLE), ("H", HOLED)]
    for size in (0.5, 3.0):
        got = spatial.overlay(polys(spark, shapes), polys(spark, tiles, "tile"), size, "unit", "tile")
        sums = {r["unit"]: (r["s"], r["a"], r["n"] == r["d"]) for r in got.groupBy("unit").agg(F.sum("area_inter").alias("s"), F.max("area_a").alias("a"), F.count("tile").alias("n"), F.count_distinct("tile").alias("d")).collect()}
        assert set(sums) == {"L", "U", "T", "H"}
        for s, a, no_duplicates in sums.values():
            assert s == pytest.approx(a, abs=1e-9) and no_duplicates


def test_box_pairs_of_mixed_sizes_match_brute_force(spark):
    rng = np.random.default_rng(9)
    def boxes(n, prefix):
        out = []
        for i in range(n):
            w = float(2.0 ** rng.integers(-8, 5))
            x, y = (rng.uniform(0, 0.3, 2) if i % 3 == 0 else rng.uniform(-20, 20, 2)).tolist()  # a third in one spot
            out.append((f"{prefix}{i}", x, y, w))
        return out
    a, b = boxes(60, "a"), boxes(60, "b")
    frame = lambda items, key: polys(spark, [(k, square(x, y, w)) for k, x, y, w in items], key)
    got = [tuple(r) for r in spatial.box_pairs(frame(a, "ka"), frame(b, "kb"), 1.0, "ka", "kb").collect()]
    want = {(p[0], q[0]) for p in a for q in b if max(p[1], q[1]) < min(p[1] + p[3], q[1] + q[3]) and max(p[2], q[2]) < min(p[2] + p[3], q[2] + q[3])}
    assert len(got) == len(set(got)) and set(got) == want


def test_points_against_brute_force_in_one_crowded_cell(spark):
    rng = np.random.default_rng(2)
    pts = rng.uniform(-1, 7, (400, 2)).round(3) + 0.0001
    pts[:150] = pts[:150] * 0.1 + 0.2  # a third of the points in one spot
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "id int, x double, y double")
    got = spatial.points_in_polygons(points, polys(spark, [("U", U_SHAPE)]), 2.0).collect()
    inside = lambda x, y: 0 < x < 6 and 0 < y < 5 and not (1 < x < 5 and y > 1)
    assert len(got) == 400
    assert {r["id"] for r in got if r["unit"] == "U"} == {i for i, (x, y) in enumerate(pts) if inside(x, y)}


def test_holes_are_outside(spark):
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.0, 2.0)], "id int, x double, y double")
    got = {r["id"]: r["unit"] for r in spatial.points_in_polygons(pts, polys(spark, [("H", HOLED)]), 1.0).collect()}
    assert got == {1: "H", 2: None}


def test_interior_point_lies_inside(spark):
    df = polys(spark, [("U", U_SHAPE), ("L", L_SHAPE), ("H", HOLED), ("T", TRIANGLE)])
    p = df.withColumn("p", g.interior_point("geom"))
    assert p.select(g.contains("geom", F.col("p.x"), F.col("p.y")).alias("ok")).where("ok").count() == 4


def test_interior_point_computes_each_step_once(spark):
    """Mentioned again inside a lambda, a step is computed again there, for each element: a square took 25 ms."""
    plan = polys(spark, [("U", U_SHAPE)]).select(g.interior_point("geom").alias("p"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("array_sort") == 2 and plan.count("flatten") == 1


def test_orientation_is_repaired_once(spark):
    df = polys(spark, [("H", HOLED)]).withColumn("f", g.oriented("geom")).withColumn("ff", g.oriented("f"))
    row = df.select(g.ring_area(F.col("f")[0][0]).alias("o"), g.ring_area(F.col("f")[0][1]).alias("h"), (F.col("f") == F.col("ff")).alias("same"), g.area("geom").alias("a")).first()
    assert tuple(row) == (-16.0, 4.0, True, 12.0)


def test_shared_edges_vanish(spark):
    got = spatial.exterior_edges(polys(spark, [("a", square(0, 0, 1)), ("b", square(1, 0, 1))])).collect()
    assert len(got) == 6 and (1.0, 0.0, 1.0, 1.0) not in {tuple(r) for r in got}


def test_best_match_counts_partners_and_keeps_unmatched(spark):
    units = polys(spark, [("a", square(0, 0, 4)), ("z", square(50, 50, 1))])
    zones = polys(spark, [("p", square(-1, -1, 2)), ("q", square(1, 0, 9))], "zone")
    got = {r["unit"]: r for r in spatial.best_match(spatial.overlay(units, zones, 2.0, "unit", "zone"), units, "unit", "zone").collect()}
    assert got["a"]["zone"] == "q" and got["a"]["coverage_pct"] == 75.0 and got["a"]["n_partners"] == 2
    assert got["z"]["zone"] is None and got["z"]["n_partners"] == 0


def ring_of(n, radius, x, y, waves):
    """A star-like polygon of ``n`` vertices."""
    t = np.linspace(0, 2 * np.pi, n, endpoint=False)
    r = radius * (1 + 0.1 * np.sin(waves * t))
    pts = np.c_[x + r * np.cos(t), y + r * np.sin(t)].tolist()
    return [[[*pts, pts[0]]]]


def test_large_polygons_are_swept_in_little_memory():
    import tracemalloc

    a, b = ring_of(10_000, 10.0, 0.0, 0.0, 40), ring_of(10_000, 10.0, 3.0, 1.0, 25)
    tracemalloc.start()
    got = spatial.intersection_area(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500e6
    xs = np.random.default_rng(1).uniform(-12, 12, (400_000, 2))
    inside = lambda p, cx, cy, w: np.hypot(p[:, 0] - cx, p[:, 1] - cy) < 10 * (1 + 0.1 * np.sin(w * np.arctan2(p[:, 1] - cy, p[:, 0] - cx)))
    assert got == pytest.approx(24**2 * np.mean(inside(xs, 0, 0, 40) & inside(xs, 3, 1, 25)), rel=0.01)


def test_sweep_in_chunks_finds_the_crossings_of_all_pairs():
    a, b = (spatial._edges_of(ring_of(n, 5.0, x, 0.0, w)) for n, x, w in ((300, 0.0, 7), (211, 1.0, 11)))
    assert np.allclose(np.sort(spatial._crossings(a, b, chunk=8)), np.sort(spatial._crossings_of(a, b)))


def test_equal_shapes_meet_once_and_every_pair_of_keys_is_found(spark, monkeypatch):
    import geopanel.operators.spatial as spatial

    asked, real = [], spatial.box_pairs

    def counted(a, b, *rest):
        asked.append((a.count(), b.count()))
        return real(a, b, *rest)

    monkeypatch.setattr(spatial, "box_pairs", counted)
    x = (F.col("unit") % 2) * 10.0
    layer = lambda n, shift: spark.range(n).withColumnRenamed("id", "unit").select("unit", g.rectangle(x + shift, F.lit(0.0), x + shift + 10.0, F.lit(10.0)).alias("geom"))
    rows = spatial.overlay(layer(20, 0.0), layer(30, 4.0).withColumnRenamed("unit", "other"), 10.0, "unit", "other").collect()
    assert asked == [(2, 2)]
    want = {(u, o): 60.0 if u % 2 == o % 2 else 40.0 for u in range(20) for o in range(30) if u % 2 >= o % 2}
    assert {(r.unit, r.other): r.area_inter for r in rows} == want and len(rows) == len(want)
    assert {(r.area_a, r.area_b) for r in rows} == {(100.0, 100.0)}
