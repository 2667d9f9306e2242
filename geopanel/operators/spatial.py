"""Spatial joins by grid keys.

Both sides are mapped to grid cells and equi-joined on the cell; the exact predicate runs on the
surviving candidates. A pair is kept only in the cell holding the lower-left corner of the bounding
boxes' intersection, so no de-duplicating shuffle is needed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geopanel.functions import geometry as g
from geopanel.functions import rules
from geopanel.session import materialised


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / size)


def _covering(df: DataFrame, geom: str, size: float, prefix: str, box: str | None = None) -> DataFrame:
    """One row per grid cell a geometry's bounding box touches."""
    out = df.withColumn("_b", F.col(box) if box else g.bounds(geom))
    out = out.select("*", *[F.col(f"_b.{c}").alias(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2")]).drop("_b")
    span = lambda lo, hi: F.sequence(_cell(F.col(f"{prefix}{lo}"), size), _cell(F.col(f"{prefix}{hi}"), size))
    return out.withColumn("_cx", F.explode(span("x1", "x2"))).withColumn("_cy", F.explode(span("y1", "y2")))


def points_in_polygons(points: DataFrame, polygons: DataFrame, size: float, unit: str = "unit", geom: str = "geom") -> DataFrame:
    """Left join of points (``x, y``) to the polygon that contains them; ``unit`` is NULL outside.

    Each point falls into exactly one grid cell, so points are never duplicated before the join. A
    crowded cell splits by rows of the point side (adaptive skew join); polygons carry the small side.
    """
    placed = points.withColumn("_cx", _cell(F.col("x"), size)).withColumn("_cy", _cell(F.col("y"), size))
    cover = _covering(polygons.select(unit, geom), geom, size, "_p")
    x, y = F.col("x"), F.col("y")
    near = x.between(F.col("_px1"), F.col("_px2")) & y.between(F.col("_py1"), F.col("_py2"))
    cells = ["_cx", "_cy"]
    left, right = placed.alias("l"), cover.alias("r")
    on = (F.col("l._cx") == F.col("r._cx")) & (F.col("l._cy") == F.col("r._cy")) & near & g.contains(F.col(f"r.{geom}"), x, y)
    joined = left.join(right, on, "left")
    return joined.select(*[F.col(f"l.{c}") for c in placed.columns if c not in cells], F.col(f"r.{unit}").alias(unit))


# --- overlay -----------------------------------------------------------------------------------


def _edges_of(multi) -> np.ndarray:
    rows = []
    for polygon in multi:
        for ring in polygon:
            pts = np.array([np.asarray(p, dtype=float) for p in ring])
            rows.append(np.hstack([pts[:-1], pts[1:]]))
    e = np.vstack(rows)
    return e[e[:, 0] != e[:, 2]]  # vertical edges bound no slab


def _slab_intervals(edges: np.ndarray, xl: float, xr: float) -> np.ndarray:
    """Non-crossing edges over one slab as (y left, y right), bottom to top, paired inside/outside."""
    lo, hi = np.minimum(edges[:, 0], edges[:, 2]), np.maximum(edges[:, 0], edges[:, 2])
    e = edges[(lo <= xl) & (hi >= xr)]
    slope = (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0])
    y = np.stack([e[:, 1] + slope * (xl - e[:, 0]), e[:, 1] + slope * (xr - e[:, 0])], axis=1)
    return y[np.argsort(y.sum(axis=1), kind="stable")].reshape(-1, 2, 2)


def _crossings(a: np.ndarray, b: np.ndarray, chunk: int = 256) -> np.ndarray:
    """x of every proper intersection between two edge sets. ``a`` is swept from left to right; a chunk of its edges meets
    those of ``b`` that share its range in x and y, so memory follows what lies side by side, not the product of both sets."""
    box = lambda e: (np.minimum(e[:, 0], e[:, 2]), np.maximum(e[:, 0], e[:, 2]), np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3]))
    a, b = a[np.argsort(np.minimum(a[:, 0], a[:, 2]), kind="stable")], b[np.argsort(np.minimum(b[:, 0], b[:, 2]), kind="stable")]
    a_lo, a_hi, a_low, a_high = box(a)
    b_lo, b_hi, b_low, b_high = box(b)
    found = []
    for at in range(0, len(a), chunk):
        part = slice(at, at + chunk)
        until = np.searchsorted(b_lo, a_hi[part].max(), "right")
        near = np.flatnonzero((b_hi[:until] >= a_lo[part].min()) & (b_high[:until] >= a_low[part].min()) & (b_low[:until] <= a_high[part].max()))
        for first in range(0, near.size, 16 * chunk):
            found.append(_crossings_of(a[part], b[near[first : first + 16 * chunk]]))
    return np.concatenate(found) if found else np.zeros(0)


def _crossings_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    dx1, dy1 = a[:, 2] - a[:, 0], a[:, 3] - a[:, 1]
    dx2, dy2 = b[:, 2] - b[:, 0], b[:, 3] - b[:, 1]
    den = dx1[:, None] * dy2[None, :] - dy1[:, None] * dx2[None, :]
    rx, ry = b[None, :, 0] - a[:, None, 0], b[None, :, 1] - a[:, None, 1]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (rx * dy2[None, :] - ry * dx2[None, :]) / den
        u = (rx * dy1[:, None] - ry * dx1[:, None]) / den
    i, j = np.nonzero((den != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1))
    return a[i, 0] + t[i, j] * dx1[i]


def _between(edges: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """The edges over some of [lo, hi]."""
    return edges[(np.minimum(edges[:, 0], edges[:, 2]) < hi) & (np.maximum(edges[:, 0], edges[:, 2]) > lo)]


def intersection_area(left, right, block: int = 64) -> float:
    """Area of two (multi)polygons' intersection by a sweep over vertical slabs: between two neighbouring vertex or
    crossing abscissae no edges cross, so every overlap is a trapezoid. Edges beside the common range are left out, and
    a block of slabs looks at the edges over it only."""
    a, b = _edges_of(left), _edges_of(right)
    if not len(a) or not len(b):
        return 0.0
    x_lo, x_hi = max(a[:, [0, 2]].min(), b[:, [0, 2]].min()), min(a[:, [0, 2]].max(), b[:, [0, 2]].max())
    a, b = _between(a, x_lo, x_hi), _between(b, x_lo, x_hi)
    if x_lo >= x_hi or not len(a) or not len(b):
        return 0.0
    xs = np.unique(np.concatenate([a[:, 0], a[:, 2], b[:, 0], b[:, 2], _crossings(a, b), [x_lo, x_hi]]))
    xs = xs[(xs >= x_lo) & (xs <= x_hi)]
    total = 0.0
    for at in range(0, xs.size - 1, block):
        part = xs[at : at + block + 1]
        over_a, over_b = _between(a, part[0], part[-1]), _between(b, part[0], part[-1])
        if not len(over_a) or not len(over_b):
            continue
        for xl, xr in zip(part[:-1], part[1:]):
            pa, pb = _slab_intervals(over_a, xl, xr), _slab_intervals(over_b, xl, xr)
            if not len(pa) or not len(pb):
                continue
            low = np.maximum(pa[:, None, 0, :], pb[None, :, 0, :])
            high = np.minimum(pa[:, None, 1, :], pb[None, :, 1, :])
            total += float(np.maximum(high - low, 0.0).sum() * (xr - xl) / 2.0)
    return total


def _areas(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pdf["area_inter"] = [intersection_area(p, q) for p, q in zip(pdf.pop("_ga"), pdf.pop("_gb"))]
        yield pdf


def _boxed(df: DataFrame, key: str, geom: str, size: float, prefix: str) -> DataFrame:
    """``key``, bounding box and the level whose grid cells (``size · 2^level``) just exceed the box."""
    b = df.select(key, g.bounds(geom).alias("b")).select(key, *[F.col(f"b.{c}").alias(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2")])
    extent = f"greatest({prefix}x2 - {prefix}x1, {prefix}y2 - {prefix}y1)"
    return b.where(f"{extent} > 0").withColumn(f"{prefix}level", F.expr(f"int(ceil(log2({extent} / {float(size)!r}D)))"))


def _own_levels(boxes: DataFrame, prefix: str) -> Column:
    """The levels in use: at most as many as double exponents."""
    return boxes.agg(F.collect_set(f"{prefix}level")).scalar()


def _on_grid(boxes: DataFrame, size: float, prefix: str, levels: Column | None, own: bool) -> DataFrame:
    """At most four cells per box and level: its own level, or the coarser ones among ``levels``."""
    if levels is None:
        rows = boxes.withColumn("_level", F.col(f"{prefix}level"))
    else:
        rows = boxes.select("*", levels.alias("_levels"))
        test = ">=" if own else ">"
        rows = rows.withColumn("_level", F.explode(F.expr(f"filter(_levels, l -> l {test} {prefix}level)"))).drop("_levels")
    cell = lambda c: f"bigint(floor({prefix}{c} / ({float(size)!r}D * pow(2, _level))))"
    return rows.withColumn("_cx", F.expr(f"explode(sequence({cell('x1')}, {cell('x2')}))")).withColumn(
        "_cy", F.expr(f"explode(sequence({cell('y1')}, {cell('y2')}))")
    )


def box_pairs(a: DataFrame, b: DataFrame, size: float, key_a: str, key_b: str, geom_a: str = "geom", geom_b: str = "geom") -> DataFrame:
    """Keys of all pairs with overlapping bounding boxes, each once.

    Pairs meet on the grid level of the larger box. Small boxes crowded into one coarse cell are
    therefore only compared with the large boxes over it, never with each other.
    """
    # Each box table is read three times; the geometry behind it only once.
    left = materialised(_boxed(a, key_a, geom_a, size, "a_"))
    right = materialised(_boxed(b, key_b, geom_b, size, "b_"))
    lv_a, lv_b = _own_levels(left, "a_"), _own_levels(right, "b_")
    large_left = _on_grid(left, size, "a_", None, True).join(_on_grid(right, size, "b_", lv_a, True), ["_level", "_cx", "_cy"])
    large_right = _on_grid(left, size, "a_", lv_b, False).join(_on_grid(right, size, "b_", None, True), ["_level", "_cx", "_cy"])
    overlap = "greatest(a_x1, b_x1) < least(a_x2, b_x2) AND greatest(a_y1, b_y1) < least(a_y2, b_y2)"
    corner = lambda c: f"bigint(floor(greatest(a_{c}1, b_{c}1) / ({float(size)!r}D * pow(2, _level))))"
    owner = f"_cx = {corner('x')} AND _cy = {corner('y')}"
    return large_left.unionByName(large_right).where(f"{overlap} AND {owner}").select(key_a, key_b)


def _shapes(df: DataFrame, key: str, geom: str, prefix: str) -> tuple[DataFrame, DataFrame]:
    """Which shape every key has, and every shape once: geometries are one shape if all their numbers are equal."""
    shape, own = f"_{prefix}", f"_g{prefix}"
    digest = F.unhex(F.sha2(F.to_json(F.col(geom)), 256))
    keyed = materialised(df.where(F.col(geom).isNotNull()).select(key, digest.alias(shape), F.col(geom).alias(own)))
    return keyed.select(key, shape), keyed.groupBy(shape).agg(F.first(own).alias(own))


def overlay(a: DataFrame, b: DataFrame, size: float, key_a: str, key_b: str, geom_a: str = "geom", geom_b: str = "geom") -> DataFrame:
    """``key_a, key_b, area_a, area_b, area_inter`` of every overlapping pair. Boxes and geometries meet once for each pair of
    different shapes, however many keys share these; keys join the pairs that overlap. Geometries join only the surviving
    candidates; the grid join moves boxes."""
    keys_a, shapes_a = _shapes(a, key_a, geom_a, "a")
    keys_b, shapes_b = _shapes(b, key_b, geom_b, "b")
    left = shapes_a.withColumn("area_a", g.area("_ga"))
    right = shapes_b.withColumn("area_b", g.area("_gb"))
    pairs = box_pairs(shapes_a, shapes_b, size, "_a", "_b", "_ga", "_gb").join(left, "_a").join(right, "_b")
    pairs = pairs.select("_a", "_b", "area_a", "area_b", "_ga", "_gb")
    met = pairs.mapInPandas(_areas, "_a binary, _b binary, area_a double, area_b double, area_inter double").where(F.col("area_inter") > 0)
    # Written, so that what keys multiply is known by its rows.
    keyed = materialised(met).join(keys_a, "_a").join(keys_b, "_b")
    return keyed.select(key_a, key_b, "area_a", "area_b", "area_inter")


def best_match(pairs: DataFrame, units: DataFrame, key: str, partner: str, keep: Sequence[str] = ()) -> DataFrame:
    """The partner with the greatest overlap per unit (smallest key on ties), coverage in % and the
    number of partners; units without any stay, with 0 partners."""
    best = F.min(F.struct((-F.col("area_inter")).alias("k"), F.col(partner).alias("p"), "area_a", *keep))
    agg = pairs.groupBy(key).agg(best.alias("m"), F.count_distinct(partner).alias("n_partners"))
    picked = agg.select(
        key, F.col("m.p").alias(partner), *[F.col(f"m.{c}").alias(c) for c in keep],
        F.bround(-F.col("m.k") / F.col("m.area_a") * 100.0, 1).alias("coverage_pct"),
        "n_partners",
    )
    return units.select(key).join(picked, key, "left").withColumn("n_partners", F.coalesce("n_partners", F.lit(0)))


def boundary_crosswalk(pairs: DataFrame, units: DataFrame, key: str = "unit", partner: str = "unit_prev") -> DataFrame:
    """Best predecessor of each unit, overlap fractions, children of the predecessor and relation."""
    own, theirs = F.col("area_inter") / F.col("area_a"), F.col("area_inter") / F.col("area_b")
    children = pairs.where(own >= 0.5).groupBy(partner).agg(F.count_distinct(key).alias("children_prev"))
    best = F.min(F.struct((-F.col("area_inter")).alias("k"), F.col(partner).alias("p"), own.alias("fo"), theirs.alias("ft")))
    top = pairs.groupBy(key).agg(best.alias("m")).select(
        key, F.col("m.p").alias(partner), F.col("m.fo").alias("frac_own"), F.col("m.ft").alias("frac_prev")
    )
    out = units.select(key).join(top, key, "left").join(children, partner, "left")
    relation = rules.boundary_relation(F.col(key), F.col(partner), F.col("frac_own"), F.col("frac_prev"), F.col("children_prev"))
    return out.select(key, partner, "frac_own", "frac_prev", "children_prev", relation.alias("relation"))


def largest_per_key(polygons: DataFrame, key: str, geom: str = "geom") -> DataFrame:
    """One polygon per key: the largest; ties by the geometry itself. Duplicates combine map-side."""
    rest = [c for c in polygons.columns if c != key]
    ranked = F.max(F.struct(g.area(geom).alias("_area"), *rest))
    return polygons.groupBy(key).agg(ranked.alias("m")).select(key, *[F.col(f"m.{c}").alias(c) for c in rest])


def exterior_edges(polygons: DataFrame, geom: str = "geom", keys: Sequence[str] = ()) -> DataFrame:
    """Edges seen exactly once over all polygons (of a key) lie on the outside."""
    edges = polygons.select(*keys, F.explode(g.ring_edges_normalised(geom)).alias("edge"))
    once = edges.groupBy(*keys, "edge").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 1)
    return once.select(*keys, F.col("edge.a.x").alias("x1"), F.col("edge.a.y").alias("y1"), F.col("edge.b.x").alias("x2"), F.col("edge.b.y").alias("y2"))


def outside_box(points: DataFrame, box: tuple[float, float, float, float], flag: Column, by: str) -> DataFrame:
    """Per cut: points, points flagged valid, and those of them outside the box."""
    x1, y1, x2, y2 = box
    inside = F.col("x").between(x1, x2) & F.col("y").between(y1, y2)
    return points.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("n_valid"), F.count_if(flag & ~inside).alias("n_outside")
    )


def layer_extent(layer: DataFrame, kind: str = "kind", geom: str = "geom") -> DataFrame:
    """Geometry types and bounding box of a layer."""
    b = layer.select(kind, g.bounds(geom).alias("b"))
    return b.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("b.x1").isNull()).alias("n_without"),
        F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("kinds"),  # at most the GeoJSON type names
        F.min("b.x1").alias("x1"), F.min("b.y1").alias("y1"), F.max("b.x2").alias("x2"), F.max("b.y2").alias("y2"),
    )
