"""Positions: distances, projections, grid cells and polygon tests as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: A local equirectangular frame for cell grids: metres a degree at its origin.
ORIGIN, METRES_LON, METRES_LAT = (-8.0, 53.5), 66_000, 111_000
#: Transverse Mercator grid 2157: fixed values of its ellipsoid (GRS80) and of its origin.
AXIS, FLATTENING, SCALE, CENTRE, EAST, NORTH = 6378137.0, 1 / 298.257222101, 0.99982, (-8.0, 53.5), 600_000.0, 750_000.0


def distance_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance by the haversine rule."""
    a, b = F.radians(lat1), F.radians(lat2)
    dlat, dlon = b - a, F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), F.lit(2)) + F.cos(a) * F.cos(b) * F.pow(F.sin(dlon / 2), F.lit(2))
    return F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * (2 * EARTH_KM)


def distance_sql(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    h = f"power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians({lon2} - {lon1}) / 2), 2)"
    return f"(asin(sqrt(least({h}, 1.0))) * {2 * EARTH_KM})"


def metres(km: Column) -> Column:
    return F.floor(km * 1000 + 0.5).cast("long")


def metres_sql(km: str) -> str:
    return f"CAST(floor({km} * 1000 + 0.5) AS BIGINT)"


def to_metres(lon: Column, lat: Column) -> tuple[Column, Column]:
    """x and y in whole metres from the frame's origin."""
    return F.floor((lon - ORIGIN[0]) * METRES_LON + 0.5).cast("long").alias("x"), F.floor((lat - ORIGIN[1]) * METRES_LAT + 0.5).cast("long").alias("y")


def to_metres_sql(lon: str, lat: str) -> str:
    return f"CAST(floor(({lon} - ({ORIGIN[0]})::DOUBLE) * {METRES_LON} + 0.5) AS BIGINT) AS x, CAST(floor(({lat} - ({ORIGIN[1]})::DOUBLE) * {METRES_LAT} + 0.5) AS BIGINT) AS y"


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * 6378137.0, F.log(F.tan(F.radians(lat) / 2 + math.pi / 4)) * 6378137.0


def tile_box(z: int, x: int, y: int) -> tuple[float, float, float, float]:
    """West, south, east and north edge of a map tile in web-Mercator metres."""
    half, size = math.pi * 6378137.0, 2 * math.pi * 6378137.0 / 2**z
    return -half + x * size, half - (y + 1) * size, -half + (x + 1) * size, half - y * size


def national_grid(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing of grid 2157 by the series of the transverse Mercator projection in the third flattening."""
    n = FLATTENING / (2 - FLATTENING)
    radius = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)

    def conformal(phi: Column) -> Column:
        s = F.sin(phi)
        return F.sinh(F.atanh(s) - F.atanh(s * e) * e)

    t, dl = conformal(F.radians(lat)), F.radians(lon - CENTRE[0])
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(t * t + 1))
    north = xi + sum(a * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) for j, a in enumerate(alpha, 1))
    east = eta + sum(a * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) for j, a in enumerate(alpha, 1))
    s0 = math.sin(math.radians(CENTRE[1]))
    t0 = math.atan(math.sinh(math.atanh(s0) - e * math.atanh(e * s0)))
    origin = t0 + sum(a * math.sin(2 * j * t0) for j, a in enumerate(alpha, 1))
    return east * (SCALE * radius) + EAST, (north - origin) * (SCALE * radius) + NORTH


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point is inside a closed ring of (x, y) points, by counting crossings of a ray; a point on an edge counts as inside. Edges are looked at only where its box holds the point."""
    edges = F.transform(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: F.struct(F.element_at(ring, i).alias("a"), F.element_at(ring, i + 1).alias("b")))

    def crossed(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        return ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)

    def touched(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        return ((bx - ax) * (y - ay) == (by - ay) * (x - ax)) & x.between(F.least(ax, bx), F.greatest(ax, bx)) & y.between(F.least(ay, by), F.greatest(ay, by))

    boxed = x.between(F.array_min(ring["x"]), F.array_max(ring["x"])) & y.between(F.array_min(ring["y"]), F.array_max(ring["y"]))
    return boxed & (F.exists(edges, touched) | (F.size(F.filter(edges, crossed)) % 2 == 1))


def segment_distance(x: Column, y: Column, ring: Column) -> Column:
    """Distance from a point to the nearest edge of a ring."""

    def to_edge(i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, i + 1)
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        along = ((x - a["x"]) * dx + (y - a["y"]) * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-12))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
        return F.sqrt(F.pow(x - a["x"] - dx * t, F.lit(2)) + F.pow(y - a["y"] - dy * t, F.lit(2)))

    return F.array_min(F.transform(F.sequence(F.lit(1), F.size(ring) - 1), to_edge))
