"""Points, distances and shapes as Column arithmetic.  Coordinates are [longitude, latitude]."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclathe.context import SpecError
from doclathe.functions import values
from doclathe.functions.values import Val

EARTH_METERS = 6378137.0
#: Longest ring that is unrolled into one expression; longer ones are folded over an array.
UNROLL = 200


def point_of(v: Val) -> tuple[Column, Column] | None:
    """x and y of [x, y], of {coordinates: [x, y]}, or of an object's first two numbers."""
    if isinstance(v.dtype, T.StructType) and "coordinates" in v.dtype.names:
        v = values.field(v, "coordinates")
    if isinstance(v.dtype, T.ArrayType) and values.kind_of(v.dtype.elementType) == "number":
        return F.get(v.col, F.lit(0)).cast("double"), F.get(v.col, F.lit(1)).cast("double")
    if isinstance(v.dtype, T.StructType):
        numbers = [n for n in v.dtype.names if values.kind_of(v.dtype[n].dataType) == "number"][:2]
        if len(numbers) == 2:
            return tuple(values.field(v, n).col.cast("double") for n in numbers)
    return None


def literal_point(spec) -> tuple[float, float]:
    if isinstance(spec, dict):
        if "coordinates" in spec:
            spec = spec["coordinates"]
        else:
            spec = [x for x in spec.values() if isinstance(x, (int, float)) and not isinstance(x, bool)]
    if isinstance(spec, (list, tuple)) and len(spec) >= 2 and all(isinstance(x, (int, float)) for x in spec[:2]):
        return float(spec[0]), float(spec[1])
    raise SpecError(f"not a point: {spec!r}")


def planar(x: Column, y: Column, at: tuple[float, float]) -> Column:
    dx, dy = x - at[0], y - at[1]
    return F.sqrt(dx * dx + dy * dy)


def radians(x: Column, y: Column, at: tuple[float, float]) -> Column:
    """Great-circle distance in radians."""
    dy, dx = F.radians(y - at[1]) / 2, F.radians(x - at[0]) / 2
    h = F.sin(dy) * F.sin(dy) + F.cos(F.radians(y)) * F.cos(F.radians(F.lit(at[1]))) * F.sin(dx) * F.sin(dx)
    return 2 * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def meters(x: Column, y: Column, at: tuple[float, float]) -> Column:
    return radians(x, y, at) * EARTH_METERS


def in_box(x: Column, y: Column, corners) -> Column:
    (a, b), (c, d) = map(literal_point, corners)
    return x.between(min(a, c), max(a, c)) & y.between(min(b, d), max(b, d))


def _crosses(x, y, x1, y1, x2, y2) -> Column:
    """Whether a ray from (x, y) to the right crosses the edge; edges on one level never count."""
    return ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * F.try_divide(y - y1, y2 - y1) + x1)


def in_ring(x: Column, y: Column, ring) -> Column:
    points = [literal_point(p) for p in ring]
    if len(points) < 3:
        return F.lit(False)
    edges = [(*p, *q) for p, q in zip([points[-1], *points[:-1]], points)]
    if len(edges) <= UNROLL:
        hits = []
        for x1, y1, x2, y2 in edges:
            if y1 != y2:
                hits.append((F.lit(y1) > y).__ne__(F.lit(y2) > y) & (x < (x2 - x1) / (y2 - y1) * (y - y1) + x1))
        return reduce(lambda a, b: a != b, hits, F.lit(False))
    table = F.array(*(F.array(*(F.lit(c) for c in e)) for e in edges))
    return F.aggregate(table, F.lit(False), lambda inside, e: inside != F.coalesce(_crosses(x, y, e[0], e[1], e[2], e[3]), F.lit(False)))


def in_geometry(x: Column, y: Column, geometry) -> Column:
    """Outer rings only."""
    kind = geometry.get("type")
    if kind == "Polygon":
        return in_ring(x, y, geometry["coordinates"][0])
    if kind == "MultiPolygon":
        return reduce(lambda a, b: a | b, (in_ring(x, y, p[0]) for p in geometry["coordinates"]), F.lit(False))
    raise SpecError("$geometry must be a Polygon or a MultiPolygon")


def in_center(x: Column, y: Column, spec) -> Column:
    return planar(x, y, literal_point(spec[0])) <= float(spec[1])


def in_center_sphere(x: Column, y: Column, spec) -> Column:
    return radians(x, y, literal_point(spec[0])) <= float(spec[1])


SHAPES = {"$box": in_box, "$center": in_center, "$centerSphere": in_center_sphere, "$polygon": in_ring, "$geometry": in_geometry}


def within(v: Val, shape: dict) -> Column:
    p = point_of(v)
    for name, f in SHAPES.items():
        if name in shape:
            return f(*p, shape[name]) if p else F.lit(False)
    raise SpecError(f"unknown shape {list(shape)}")


def near(v: Val, operand, siblings: dict, spherical: bool) -> Column:
    """A band of distances; nothing is sorted."""
    p = point_of(v)
    if isinstance(operand, (list, tuple)):
        bounds, measure, at = siblings, radians if spherical else planar, literal_point(operand)
    elif isinstance(operand, dict) and "$geometry" in operand:
        if operand["$geometry"].get("type") != "Point":
            raise SpecError("$near needs a Point")
        bounds, measure, at = operand, meters, literal_point(operand["$geometry"])
    else:
        raise SpecError("$near needs a GeoJSON Point or a coordinate pair")
    if not p:
        return F.lit(False)
    d = measure(*p, at)
    out = d.isNotNull()
    if bounds.get("$maxDistance") is not None:
        out = out & (d <= float(bounds["$maxDistance"]))
    if bounds.get("$minDistance") is not None:
        out = out & (d >= float(bounds["$minDistance"]))
    return out
