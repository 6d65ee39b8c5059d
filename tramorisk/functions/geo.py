"""Coordinates, distances and polylines as column expressions.

A polyline is ``array<struct<lon,lat>>`` in degrees; its metric form is
``array<struct<x1,y1,x2,y2>>`` with one entry per straight piece.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EARTH_RADIUS_M = 6_371_000.0
METERS_PER_DEGREE = 111_320.0
REFERENCE_LATITUDE = -12.0
# The two accepted boxes (lat_min, lat_max, lon_min, lon_max).
CITY_BOX = (-12.60, -11.45, -77.30, -76.60)
WIDE_BOX = (-13.5, -10.5, -78.0, -76.0)


def inside_box(lat: Column, lon: Column, box: tuple[float, float, float, float] = CITY_BOX) -> Column:
    return lat.between(box[0], box[1]) & lon.between(box[2], box[3])


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def separation_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Planar separation at the mean latitude of two near points."""
    dlat, dlon = lat1 - lat2, (lon1 - lon2) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.lit(111_195.0) * F.sqrt(dlat * dlat + dlon * dlon)


def local_xy(lon: Column, lat: Column, latitude: float = REFERENCE_LATITUDE) -> tuple[Column, Column]:
    """Metres on a plane touching the city's latitude."""
    return (lon * F.lit(METERS_PER_DEGREE * math.cos(math.radians(latitude))), lat * F.lit(METERS_PER_DEGREE))


def _krueger() -> tuple[float, float, list[float]]:
    """Scaled radius, eccentricity and forward coefficients on WGS84."""
    flattening = 1 / 298.257223563
    n = flattening / (2 - flattening)
    radius = 6_378_137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
             13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
             61 * n**3 / 240 - 103 * n**4 / 140,
             49561 * n**4 / 161280]
    return radius, 2 * math.sqrt(n) / (1 + n), alpha


def utm_xy(lon: Column, lat: Column, zone: int = 18, south: bool = True) -> tuple[Column, Column]:
    """Transverse Mercator easting and northing, fourth-order series."""
    radius, ecc, alpha = _krueger()
    phi, dlam = F.radians(lat), F.radians(lon - F.lit(float(6 * zone - 183)))
    t = F.sinh(F.atanh(F.sin(phi)) - F.lit(ecc) * F.atanh(F.lit(ecc) * F.sin(phi)))
    xi0 = F.atan2(t, F.cos(dlam))
    eta0 = F.atanh(F.sin(dlam) / F.sqrt(F.lit(1.0) + t * t))
    xi, eta = xi0, eta0
    for j, a in enumerate(alpha, 1):
        xi = xi + F.lit(a) * F.sin(xi0 * (2 * j)) * F.cosh(eta0 * (2 * j))
        eta = eta + F.lit(a) * F.cos(xi0 * (2 * j)) * F.sinh(eta0 * (2 * j))
    scale = 0.9996 * radius
    return F.lit(500_000.0) + F.lit(scale) * eta, F.lit(10_000_000.0 if south else 0.0) + F.lit(scale) * xi


def metric_pieces(points: Column, project=local_xy) -> Column:
    """Straight pieces in metres of a polyline in degrees."""
    flat = F.transform(points, lambda p: F.struct(*[c.alias(n) for c, n in zip(project(p["lon"], p["lat"]), "xy")]))
    return F.zip_with(F.slice(flat, 1, F.size(flat) - 1), F.slice(flat, 2, F.size(flat) - 1),
                      lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"),
                                            b["x"].alias("x2"), b["y"].alias("y2")))


def piece_length(piece: Column) -> Column:
    dx, dy = piece["x2"] - piece["x1"], piece["y2"] - piece["y1"]
    return F.sqrt(dx * dx + dy * dy)


def polyline_length(pieces: Column) -> Column:
    return F.aggregate(pieces, F.lit(0.0), lambda acc, p: acc + piece_length(p))


def distance_to_piece(x: Column, y: Column, piece: Column) -> Column:
    """Distance from a point to a straight piece, ends included."""
    dx, dy = piece["x2"] - piece["x1"], piece["y2"] - piece["y1"]
    norm = dx * dx + dy * dy
    # a NULL piece (past the end of a short polyline) must stay NULL
    along = ((x - piece["x1"]) * dx + (y - piece["y1"]) * dy) / F.when(norm == 0, F.lit(1.0)).otherwise(norm)
    t = F.when(along <= 0, F.lit(0.0)).when(along >= 1, F.lit(1.0)).otherwise(along)
    ex, ey = x - (piece["x1"] + t * dx), y - (piece["y1"] + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def distance_to_polyline(x: Column, y: Column, pieces: Column, unrolled: int = 3) -> Column:
    """Least distance to any piece.

    The first pieces are spelled out, which compiles; only the rest of longer
    polylines goes through an array function.
    """
    first = [distance_to_piece(x, y, F.get(pieces, F.lit(i))) for i in range(unrolled)]
    rest = F.array_min(F.transform(F.slice(pieces, unrolled + 1, F.size(pieces)), lambda p: distance_to_piece(x, y, p)))
    near = F.least(*first)
    return F.when(F.size(pieces) <= unrolled, near).otherwise(F.least(near, rest))


def chord_m(piece: Column, cx: Column, cy: Column, radius: Column) -> Column:
    """Metres of a straight piece inside a disc."""
    dx, dy = piece["x2"] - piece["x1"], piece["y2"] - piece["y1"]
    fx, fy = piece["x1"] - cx, piece["y1"] - cy
    a, b, c = dx * dx + dy * dy, fx * dx + fy * dy, fx * fx + fy * fy - radius * radius
    disc = b * b - a * c
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    safe = F.when(a > 0, a).otherwise(F.lit(1.0))
    enter = F.greatest((-b - root) / safe, F.lit(0.0))
    leave = F.least((-b + root) / safe, F.lit(1.0))
    return F.when((disc > 0) & (a > 0) & (leave > enter), (leave - enter) * F.sqrt(a)).otherwise(F.lit(0.0))


def point_along(pieces: Column, fraction: Column) -> Column:
    """``struct<x,y>`` at a fraction of the polyline's length."""
    target = fraction * polyline_length(pieces)
    start = F.struct(F.lit(0.0).alias("done"), F.element_at(pieces, 1)["x1"].alias("x"),
                     F.element_at(pieces, 1)["y1"].alias("y"))

    def walk(acc: Column, p: Column) -> Column:
        size = piece_length(p)
        t = F.least(F.greatest((target - acc["done"]) / F.when(size > 0, size).otherwise(F.lit(1.0)),
                               F.lit(0.0)), F.lit(1.0))
        reached = target > acc["done"]
        return F.struct((acc["done"] + size).alias("done"),
                        F.when(reached, p["x1"] + t * (p["x2"] - p["x1"])).otherwise(acc["x"]).alias("x"),
                        F.when(reached, p["y1"] + t * (p["y2"] - p["y1"])).otherwise(acc["y"]).alias("y"))

    return F.aggregate(pieces, start, walk, lambda acc: F.struct(acc["x"].alias("x"), acc["y"].alias("y")))


def drop_near_repeats(points: Column, gap_m: float = 0.1) -> Column:
    """Polyline without vertices closer than ``gap_m`` to the kept one before."""
    first = F.slice(points, 1, 1)
    return F.aggregate(F.slice(points, 2, F.size(points)), first, lambda kept, p: F.when(
        haversine_m(F.element_at(kept, -1)["lat"], F.element_at(kept, -1)["lon"], p["lat"], p["lon"]) > gap_m,
        F.concat(kept, F.array(p))).otherwise(kept))


def orient(points: Column, lat: Column, lon: Column) -> Column:
    """Reverse a polyline whose last vertex is the one nearer to the start."""
    head, tail = F.element_at(points, 1), F.element_at(points, -1)
    backwards = haversine_m(lat, lon, tail["lat"], tail["lon"]) < haversine_m(lat, lon, head["lat"], head["lon"])
    return F.when(backwards, F.reverse(points)).otherwise(points)


def segment_id(u: Column, v: Column, way: Column) -> Column:
    """Identifier shared by both directions; ``way`` is an array of way ids."""
    u, v = u.cast("string"), v.cast("string")
    ways = F.array_join(F.array_sort(F.transform(way, lambda w: w.cast("string"))), "-")
    return F.concat_ws("-", F.lit("OSM"), F.least(u, v), F.greatest(u, v), ways)
