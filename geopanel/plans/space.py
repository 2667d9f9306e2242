"""Spatial operators: suppliers as grid squares, customers as points."""

from __future__ import annotations

from pyspark.sql import functions as F

from geopanel.functions import geometry as g
from geopanel.operators import quality, spatial
from geopanel.plans.registry import query, r6, with_ctes
from geopanel.plans.roles import CELL_SIZE, Roles
from geopanel.session import spread

SHIFT = 2.5
# Overlap areas of axis-aligned rectangles.
_INTER = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
_SHIFTED = f"(SELECT unit AS other, x1 + {SHIFT} AS x1, y1 + {SHIFT} AS y1, x2 + {SHIFT} AS x2, y2 + {SHIFT} AS y2 FROM squares)"
_PAIRS = f"SELECT a.unit, b.other, {_INTER} AS ai FROM squares a JOIN {_SHIFTED} b ON {_INTER} > 0"


def _layers(r: Roles):
    own = r.squares(r.suppliers).select("unit", "geom")
    other = r.squares(r.suppliers, SHIFT).select(F.col("unit").alias("other"), "geom")
    return own, other


def _pairs(r: Roles):
    own, other = _layers(r)
    return spatial.overlay(own, other, CELL_SIZE, "unit", "other")


@query("j07_point_in_polygon", with_ctes("pts", "squares", body="SELECT point, unit FROM pts LEFT JOIN squares ON x > x1 AND x < x2 AND y > y1 AND y < y2"))
def within(r: Roles):
    own, _ = _layers(r)
    return spatial.points_in_polygons(r.customers.select("point", "x", "y"), own, CELL_SIZE).select("point", "unit")


@query("j07b_points_per_unit", with_ctes("pts", "squares", body=f"SELECT unit, count(*) AS n, {r6('sum(value)')} AS value FROM pts JOIN squares ON x > x1 AND x < x2 AND y > y1 AND y < y2 GROUP BY 1"))
def per_unit(r: Roles):
    own, _ = _layers(r)
    placed = spatial.points_in_polygons(r.customers.select("point", "x", "y", "value"), own, CELL_SIZE)
    return placed.where("unit IS NOT NULL").groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


@query("j08_overlay_areas", with_ctes("squares", body=f"SELECT unit, other, 100e0 AS area_a, 100e0 AS area_b, {r6('ai')} AS area_inter FROM ({_PAIRS})"))
def overlay(r: Roles):
    return _pairs(r)


@query(
    "j09_best_match",
    with_ctes("squares", body=f"""SELECT s.unit, b.other, {r6('round_even(ai, 1)')} AS coverage_pct, coalesce(n, 0) AS n_partners FROM squares s LEFT JOIN (
        SELECT unit, other, ai, row_number() OVER (PARTITION BY unit ORDER BY ai DESC, other) AS k, count(*) OVER (PARTITION BY unit) AS n FROM ({_PAIRS})) b ON b.unit = s.unit AND k = 1"""),
)
def best(r: Roles):
    return spatial.best_match(_pairs(r), r.suppliers, "unit", "other")


@query(
    "j10_boundary_relation",
    with_ctes(
        "squares",
        body=f"""WITH old AS (SELECT unit AS unit_prev, x1, y1, CASE WHEN unit % 4 = 0 THEN x2 + 10 ELSE x2 END AS x2, y2, CASE WHEN unit % 4 = 0 THEN 200e0 ELSE 100e0 END AS ab FROM squares WHERE unit % 4 <> 1 AND unit % 7 <> 3),
        p AS (SELECT unit, unit_prev, ai, ai / 100 AS fo, ai / ab AS ft FROM (SELECT a.unit, b.unit_prev, ab, {_INTER} AS ai FROM squares a JOIN old b ON {_INTER} > 0)),
        ch AS (SELECT unit_prev, count(DISTINCT unit) AS c FROM p WHERE fo >= 0.5 GROUP BY 1),
        m AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY ai DESC, unit_prev) AS k FROM p)
        SELECT s.unit, m.unit_prev, {r6('fo')} AS frac_own, {r6('ft')} AS frac_prev, c AS children_prev,
        CASE WHEN m.unit_prev IS NULL THEN 'sin_contraparte' WHEN fo >= 0.95 AND ft >= 0.95 THEN CASE WHEN s.unit = m.unit_prev THEN 'misma' ELSE 'misma_otra_clave' END
             WHEN fo >= 0.95 AND c > 1 THEN 'division' WHEN ft >= 0.95 THEN 'fusion_o_expansion' ELSE 'cambio_limites' END AS relation
        FROM squares s LEFT JOIN m ON m.unit = s.unit AND k = 1 LEFT JOIN ch ON ch.unit_prev = m.unit_prev""",
    ).replace("\nWITH old", ",\nold", 1),
)
def relation(r: Roles):
    """Old layer: some squares span two of today's (split), some vanished."""
    own, _ = _layers(r)
    old = r.squares(r.suppliers).where("unit % 4 <> 1 AND unit % 7 <> 3").withColumn("x2", F.expr("if(unit % 4 = 0, x2 + 10, x2)"))
    old = old.select(F.col("unit").alias("unit_prev"), g.rectangle(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("geom"))
    pairs = spatial.overlay(own, old, CELL_SIZE, "unit", "unit_prev")
    return spatial.boundary_crosswalk(pairs, r.suppliers)


_EDGES = " UNION ALL ".join(
    f"SELECT grp, {a} AS x1, {b} AS y1, {c} AS x2, {d} AS y2 FROM squares" for a, b, c, d in (("x1", "y1", "x2", "y1"), ("x2", "y1", "x2", "y2"), ("x1", "y2", "x2", "y2"), ("x1", "y1", "x1", "y2"))
)


@query("j21_exterior_edges", with_ctes("squares", body=f"SELECT {r6('x1')} AS x1, {r6('y1')} AS y1, {r6('x2')} AS x2, {r6('y2')} AS y2 FROM ({_EDGES}) GROUP BY x1, y1, x2, y2 HAVING count(*) = 1"))
def exterior(r: Roles):
    return spatial.exterior_edges(r.squares(r.suppliers).select("grp", "geom"))


@query("j21b_group_boundaries", with_ctes("squares", body=f"SELECT grp, x1, y1, x2, y2 FROM ({_EDGES}) GROUP BY ALL HAVING count(*) = 1"))
def group_boundaries(r: Roles):
    return spatial.exterior_edges(r.squares(r.suppliers).select("grp", "geom"), keys=["grp"])


@query("f10_ring_area_and_orientation", with_ctes("squares", body="SELECT unit, 100e0 AS area, -100e0 AS outer_area, [x1, x1, x2, x2, x1] AS xs FROM squares"))
def orientation(r: Roles):
    """Counter-clockwise squares are turned so that the outer ring has negative area."""
    fixed = r.squares(r.suppliers).withColumn("fixed", g.oriented("geom"))
    ring = F.col("fixed")[0][0]
    return fixed.select("unit", g.area("geom").alias("area"), g.ring_area(ring).alias("outer_area"), F.transform(ring, lambda p: p[0]).alias("xs"))


@query("f11_interior_point", with_ctes("squares", body=f"SELECT unit, {r6('x1 + 5')} AS x, {r6('y1 + 5')} AS y FROM squares"))
def interior(r: Roles):
    p = g.interior_point("geom")
    return r.squares(spread(r.suppliers, "unit")).select("unit", p.alias("p")).select("unit", "p.x", "p.y")


@query("f12_layer_extent", with_ctes("squares", body="SELECT count(*) AS n, 0 AS n_without, 'MultiPolygon' AS kinds, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM squares"))
def extent(r: Roles):
    return spatial.layer_extent(r.squares(r.suppliers).select(F.lit("MultiPolygon").alias("kind"), "geom"))


@query("f13_metric_plane", with_ctes("pts", body=f"""SELECT point, {r6('(x / 1000 - 99.23e0 + 99.13e0) * (6371008.8e0 * pi() / 180 * cos(radians(19.35e0)))')} AS mx,
    {r6('(y / 1000 + 19.3e0 - 19.35e0) * (6371008.8e0 * pi() / 180)')} AS my FROM pts"""))
def metric(r: Roles):
    p = r.customers.select("point", (F.col("x") / 1000 - 99.23).alias("lon"), (F.col("y") / 1000 + 19.3).alias("lat"))
    return p.select("point", g.to_metres("lon", "lat").alias("m")).select("point", F.col("m.x").alias("mx"), F.col("m.y").alias("my"))


_DEGREES = "(SELECT unit, (unit % 20) * 0.5e0 - 104 AS w, (unit // 20) * 0.5e0 % 60 - 30 AS s FROM supps)"


@query(
    "f13b_equal_area_overlay",
    with_ctes("supps", body=f"""SELECT a.unit, b.unit AS other, {r6('round(6371.0088e0 ** 2 * radians(least(a.w, b.w + 0.2e0) + 0.5e0 - greatest(a.w, b.w + 0.2e0)) * (sin(radians(least(a.s, b.s) + 0.5e0)) - sin(radians(greatest(a.s, b.s)))), 3)')} AS km2
    FROM {_DEGREES} a JOIN {_DEGREES} b ON least(a.w, b.w + 0.2e0) + 0.5e0 > greatest(a.w, b.w + 0.2e0) + 1e-9 AND least(a.s, b.s) + 0.5e0 > greatest(a.s, b.s) + 1e-9"""),
)
def equal_area(r: Roles):
    """Squares of half a degree between 30 degrees south and north against the same moved eastwards, in square kilometres on the sphere."""
    w, s = (F.col("unit") % 20) * 0.5 - 104.0, (F.floor(F.col("unit") / 20) * 0.5) % 60 - 30.0
    layer = lambda key, east: r.suppliers.select(F.col("unit").alias(key), g.on_equal_area_plane(g.rectangle(w + east, s, w + east + 0.5, s + 0.5)).alias("geom"))
    pairs = spatial.overlay(layer("unit", 0.0), layer("other", 0.2), 50_000.0, "unit", "other")
    return pairs.where("area_inter > 1").select("unit", "other", F.round(F.col("area_inter") / 1e6, 3).alias("km2"))


@query("u06_largest_polygon_per_key", with_ctes("squares", body="SELECT k, max(w) * 10 AS area FROM (SELECT unit % 30 AS k, 10e0 + unit % 7 AS w FROM squares) GROUP BY 1"))
def largest(r: Roles):
    wide = r.squares(r.suppliers).select((F.col("unit") % 30).alias("k"), g.rectangle(F.col("x1"), F.col("y1"), F.col("x2") + F.col("unit") % 7, F.col("y2")).alias("geom"))
    return spatial.largest_per_key(wide, "k").select("k", g.area("geom").alias("area"))


@query("q14_match_quality", with_ctes("squares", body=f"""SELECT count(*) AS n_units, count(*) FILTER (WHERE other IS NULL) AS n_unmatched, {r6('avg(c)')} AS mean_coverage, coalesce(avg(c) > 50, false) AS ok FROM (
    SELECT s.unit, b.other, round_even(ai, 1) AS c FROM squares s LEFT JOIN (SELECT unit, other, ai, row_number() OVER (PARTITION BY unit ORDER BY ai DESC, other) AS k FROM ({_PAIRS})) b ON b.unit = s.unit AND k = 1)"""))
def match_quality(r: Roles):
    return quality.match_quality(spatial.best_match(_pairs(r), r.suppliers, "unit", "other"), "other")
