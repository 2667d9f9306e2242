"""Planar geometry on nested arrays: ring = [[x, y], …], polygon = [outer, hole, …], multi = [polygon, …]."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from geopanel.functions.scalars import col

MULTI = "array<array<array<array<double>>>>"
POLYGON = "array<array<array<double>>>"


def parse_multipolygon(kind: str | Column, coordinates: str | Column) -> Column:
    """GeoJSON coordinates kept as text -> MultiPolygon arrays, for either geometry type."""
    text = col(coordinates)
    return F.when(col(kind) == "MultiPolygon", F.from_json(text, MULTI)).when(
        col(kind) == "Polygon", F.array(F.from_json(text, POLYGON))
    )


def rectangle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Closed counter-clockwise rectangle as a MultiPolygon."""
    ring = F.array(*[F.array(x.cast("double"), y.cast("double")) for x, y in ((x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1))])
    return F.array(F.array(ring))


def _edges(ring: Column) -> Column:
    """[[x1, y1, x2, y2], …] of consecutive points."""
    n = F.size(ring)
    return F.zip_with(F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1), lambda a, b: F.concat(a, b))


def ring_area(ring: str | Column) -> Column:
    """Signed shoelace area; positive counter-clockwise."""
    cross = lambda acc, e: acc + e[0] * e[3] - e[2] * e[1]
    return F.aggregate(_edges(col(ring)), F.lit(0.0), cross, lambda s: s / 2.0)


def area(multi: str | Column) -> Column:
    """Unsigned area: outer rings minus holes."""
    def polygon_area(p: Column) -> Column:
        signs = F.transform(p, lambda r, i: F.when(i == 0, F.abs(ring_area(r))).otherwise(-F.abs(ring_area(r))))
        return F.aggregate(signs, F.lit(0.0), lambda a, x: a + x)

    return F.aggregate(F.transform(col(multi), polygon_area), F.lit(0.0), lambda a, x: a + x)


def oriented(multi: str | Column) -> Column:
    """Outer rings to negative area, holes to the opposite sign."""
    def fix(r: Column, i: Column) -> Column:
        a = ring_area(r)
        return F.when(F.when(i == 0, a > 0).otherwise(a < 0), F.reverse(r)).otherwise(r)

    return F.transform(col(multi), lambda p: F.transform(p, fix))


def bounds(multi: str | Column) -> Column:
    """struct(x1, y1, x2, y2) over outer rings."""
    pts = F.flatten(F.transform(col(multi), lambda p: p[0]))
    xs, ys = F.transform(pts, lambda q: q[0]), F.transform(pts, lambda q: q[1])
    return F.struct(
        F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2")
    )


def contains(multi: str | Column, x: Column, y: Column) -> Column:
    """Even-odd ray casting over all rings (holes included)."""
    edges = F.flatten(F.transform(F.flatten(col(multi)), _edges))
    def crosses(e: Column) -> Column:
        spans = (e[1] > y) != (e[3] > y)
        at = (e[2] - e[0]) * F.try_divide(y - e[1], e[3] - e[1]) + e[0]
        return spans & (x < at)

    return F.size(F.filter(edges, crosses)) % 2 == 1


def _held(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, the value computed once however often ``use`` names it: inside lambdas Spark computes an expression anew for each mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def interior_point(multi: str | Column) -> Column:
    """struct(x, y) strictly inside: middle of the widest inside span at half height of the largest part."""
    largest = F.element_at(
        F.array_sort(F.transform(col(multi), lambda p: F.struct((-F.abs(ring_area(p[0]))).alias("k"), p.alias("p")))), 1
    )["p"]

    def height(ys: Column) -> Column:
        # Between two vertex heights, so that the scan line never runs along an edge.
        between = lambda middle: (F.array_max(F.filter(ys, lambda v: v <= middle)) + F.array_min(F.filter(ys, lambda v: v > middle))) / 2.0
        return _held((F.array_min(ys) + F.array_max(ys)) / 2.0, between)

    def widest(hits: Column) -> Column:
        pairs = F.transform(
            F.sequence(F.lit(0), (F.size(hits) / 2 - 1).cast("int")),
            lambda i: F.struct((F.get(hits, i * 2 + 1) - F.get(hits, i * 2)).alias("w"), ((F.get(hits, i * 2 + 1) + F.get(hits, i * 2)) / 2.0).alias("x")),
        )
        return F.array_max(pairs)["x"]

    def point(part: Column, y: Column) -> Column:
        edges = F.flatten(F.transform(part, _edges))
        hits = F.array_sort(
            F.transform(
                F.filter(edges, lambda e: (e[1] > y) != (e[3] > y)),
                lambda e: (e[2] - e[0]) * ((y - e[1]) / (e[3] - e[1])) + e[0],
            )
        )
        return F.struct(_held(hits, widest).alias("x"), y.alias("y"))

    def of_part(part: Column) -> Column:
        y = _held(F.transform(part[0], lambda q: q[1]), height)
        return _held(y, lambda y: point(part, y))

    return _held(largest, of_part)


def to_metres(lon: str | Column, lat: str | Column, lon0: float = -99.13, lat0: float = 19.35) -> Column:
    """Local equirectangular plane around (lon0, lat0): struct(x, y) in metres."""
    radius = 6371008.8
    k = math.pi / 180.0 * radius
    return F.struct(
        ((col(lon) - lon0) * (k * math.cos(math.radians(lat0)))).alias("x"), ((col(lat) - lat0) * k).alias("y")
    )


def on_equal_area_plane(multi: str | Column, lon0: float = -99.13, lat0: float = 19.35) -> Column:
    """A MultiPolygon in degrees on the cylindrical equal-area plane that is true to length at ``lat0``, in metres: areas are those
    on the sphere, wherever the polygon lies."""
    radius, narrow = 6371008.8, math.cos(math.radians(lat0))
    place = lambda q: F.array(F.radians(q[0] - lon0) * (radius * narrow), F.sin(F.radians(q[1])) * (radius / narrow))
    return F.transform(col(multi), lambda p: F.transform(p, lambda r: F.transform(r, place)))


def ring_edges_normalised(multi: str | Column, digits: int = 6) -> Column:
    """Edge keys with ordered endpoints, rounded so that shared borders coincide."""
    point = lambda x, y: F.struct(F.round(x, digits).alias("x"), F.round(y, digits).alias("y"))
    edges = F.flatten(F.transform(F.flatten(col(multi)), _edges))
    def key(e: Column) -> Column:
        a, b = point(e[0], e[1]), point(e[2], e[3])
        return F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))

    return F.transform(edges, key)
