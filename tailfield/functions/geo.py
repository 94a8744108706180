"""Cell indexing, projections and distances as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tailfield.constants import ALBERS, EARTH_RADIUS_KM, GRID
from tailfield.functions.numeric import col

MERCATOR_LIMIT = 85.05112878


def cell_of(x, y, grid: dict = GRID) -> tuple[Column, Column]:
    """(row, col) of the cell whose centre is nearest; halves go to the even index."""
    gx = F.rint(col(x) / grid["res"]).cast("long")
    gy = F.rint(col(y) / grid["res"]).cast("long")
    return F.lit(grid["gy1"]) - gy, gx - F.lit(grid["gx0"])


def centre_of(row, c, grid: dict = GRID) -> tuple[Column, Column]:
    return (F.lit(grid["gx0"]) + col(c)) * F.lit(grid["res"]), (F.lit(grid["gy1"]) - col(row)) * F.lit(grid["res"])


def inside_grid(row, c, nrows, ncols) -> Column:
    row, c = col(row), col(c)
    return (row >= 0) & (row < nrows) & (c >= 0) & (c < ncols)


def block_id(x, y, size: float = 100_000.0) -> Column:
    """``<i>_<j>`` of the square block; NULL when a coordinate is missing."""
    x, y = col(x), col(y)
    text = F.concat_ws("_", F.floor(x / size).cast("string"), F.floor(y / size).cast("string"))
    return F.when(x.isNotNull() & y.isNotNull(), text)


def haversine_km(lon1, lat1, lon2, lat2, radius: float = EARTH_RADIUS_KM) -> Column:
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    dp, dl = p2 - p1, F.radians(col(lon2)) - F.radians(col(lon1))
    a = F.pow(F.sin(dp / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return 2.0 * radius * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def unit_sphere_km(lon, lat, radius: float = EARTH_RADIUS_KM) -> tuple[Column, Column, Column]:
    """Position in space; straight distances order points as great-circle distances do."""
    lon, lat = F.radians(col(lon)), F.radians(col(lat))
    return radius * F.cos(lat) * F.cos(lon), radius * F.cos(lat) * F.sin(lon), radius * F.sin(lat)


class AlbersParams:
    """Constants of an ellipsoidal equal-area conic projection, fixed at plan time."""

    def __init__(self, p: dict = ALBERS):
        f = 1.0 / p["inv_f"]
        self.a, self.lon0 = p["a"], math.radians(p["lon0"])
        self.e2 = f * (2 - f)
        self.e = math.sqrt(self.e2)
        m1, m2 = (self._m(math.radians(p[k])) for k in ("lat1", "lat2"))
        q0, q1, q2 = (self._q(math.radians(p[k])) for k in ("lat0", "lat1", "lat2"))
        self.n = (m1**2 - m2**2) / (q2 - q1)
        self.c = m1**2 + self.n * q1
        self.rho0 = self.a * math.sqrt(self.c - self.n * q0) / self.n

    def _m(self, lat: float) -> float:
        return math.cos(lat) / math.sqrt(1 - self.e2 * math.sin(lat) ** 2)

    def _q(self, lat: float) -> float:
        s = math.sin(lat)
        t = self.e * s
        return (1 - self.e2) * (s / (1 - t * t) - math.log((1 - t) / (1 + t)) / (2 * self.e))


def albers_forward(lon, lat, p: AlbersParams | None = None) -> tuple[Column, Column]:
    p = p or AlbersParams()
    s = F.sin(F.radians(col(lat)))
    t = s * p.e
    q = (s / (1.0 - t * t) - F.log((1.0 - t) / (1.0 + t)) / (2 * p.e)) * (1 - p.e2)
    rho = F.sqrt(p.c - q * p.n) * p.a / p.n
    theta = (F.radians(col(lon)) - p.lon0) * p.n
    return rho * F.sin(theta), F.lit(p.rho0) - rho * F.cos(theta)


def albers_inverse(x, y, p: AlbersParams | None = None, iterations: int = 6) -> tuple[Column, Column]:
    """(lon, lat); the latitude series is iterated a fixed number of times.

    The iteration runs inside one ``aggregate`` over a constant array, so the
    expression does not grow with the number of steps.
    """
    p = p or AlbersParams()
    x, y = col(x), col(y)
    dy = F.lit(p.rho0) - y
    rho = F.sqrt(x * x + dy * dy)
    q = (F.lit(p.c) - F.pow(rho * p.n / p.a, 2)) / p.n

    def step(phi, _):
        s = F.sin(phi)
        t = s * p.e
        one = F.lit(1.0) - t * t
        inner = q / (1 - p.e2) - s / one + F.log((F.lit(1.0) - t) / (F.lit(1.0) + t)) / (2 * p.e)
        return phi + one * one / (F.cos(phi) * 2.0) * inner

    phi = F.aggregate(F.array(*[F.lit(i) for i in range(iterations)]), F.asin(q / 2.0), step)
    lon = F.atan2(x, dy) / p.n + p.lon0
    return F.degrees(lon), F.degrees(phi)


def mercator_tile(lon, lat, zoom: int) -> tuple[Column, Column]:
    """Fractional web-map tile coordinates; latitude is clamped to the square world."""
    n = float(2**zoom)
    lat = F.radians(F.greatest(F.least(col(lat), F.lit(MERCATOR_LIMIT)), F.lit(-MERCATOR_LIMIT)))
    return (col(lon) + 180.0) / 360.0 * n, (F.lit(1.0) - F.asinh(F.tan(lat)) / math.pi) / 2.0 * n


def tile_corner(tx, ty, zoom: int) -> tuple[Column, Column]:
    n = float(2**zoom)
    lon = col(tx) / n * 360.0 - 180.0
    lat = F.degrees(F.atan(F.sinh((F.lit(1.0) - col(ty) * 2.0 / n) * math.pi)))
    return lon, lat


# Cosine series of the length of a degree.
ZONAL_KM = ((1, 111.41288), (3, -0.09350), (5, 0.00012))
MERIDIONAL_M = ((0, 111132.92), (2, -559.82), (4, 1.175), (6, -0.0023))


def _cosine_series(lat, terms) -> Column:
    r = F.radians(col(lat))
    return sum((F.cos(r * float(k)) * c for k, c in terms[1:]), F.cos(r * float(terms[0][0])) * terms[0][1])


def zonal_degree_km(lat) -> Column:
    return _cosine_series(lat, ZONAL_KM)


def meridional_degree_m(lat) -> Column:
    return _cosine_series(lat, MERIDIONAL_M)


def segment_projection(px, py, x1, y1, x2, y2) -> tuple[Column, Column]:
    """(squared distance, position 0..1) of the closest point of a segment."""
    px, py, x1, y1, x2, y2 = (col(c) for c in (px, py, x1, y1, x2, y2))
    dx, dy = x2 - x1, y2 - y1
    length2 = dx * dx + dy * dy
    raw = F.try_divide((px - x1) * dx + (py - y1) * dy, length2)
    # greatest skips NULL, so an edge of no length is its first end
    t = F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))
    ex, ey = px - (x1 + t * dx), py - (y1 + t * dy)
    return ex * ex + ey * ey, t
