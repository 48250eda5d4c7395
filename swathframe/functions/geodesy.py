"""Map projections and distances as column expressions.

Transverse Mercator follows the Krueger series in the third flattening to its sixth order (published in many places), on
the ellipsoid and constants of an EPSG code. Codes outside the table are refused.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InputError


@dataclass(frozen=True)
class Ellipsoid:
    a: float
    inverse_flattening: float

    @property
    def n(self) -> float:
        f = 1 / self.inverse_flattening
        return f / (2 - f)

    @property
    def e(self) -> float:
        f = 1 / self.inverse_flattening
        return math.sqrt(f * (2 - f))

    @property
    def radius(self) -> float:
        n = self.n
        return self.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)


WGS84, GRS80 = Ellipsoid(6378137.0, 298.257223563), Ellipsoid(6378137.0, 298.257222101)

# Coefficients of the Krueger series, rows by term, columns by power of n from the row's own order.
FORWARD_SERIES = (
    (1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800),
    (13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360),
    (61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
    (49561 / 161280, -179 / 168, 6601661 / 7257600),
    (34729 / 80640, -3418889 / 1995840),
    (212378941 / 319334400,),
)
INVERSE_SERIES = (
    (1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800),
    (1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720),
    (17 / 480, -37 / 840, -209 / 4480, 5569 / 90720),
    (4397 / 161280, -11 / 504, -830251 / 7257600),
    (4583 / 161280, -108847 / 3991680),
    (20648693 / 638668800,),
)


def series(rows, n: float) -> list[float]:
    return [sum(c * n ** (j + i + 1) for i, c in enumerate(row)) for j, row in enumerate(rows)]


@dataclass(frozen=True)
class Crs:
    epsg: int
    name: str
    ellipsoid: Ellipsoid = GRS80
    lon0: float = 0.0
    lat0: float = 0.0
    scale: float = 1.0
    east: float = 0.0
    north: float = 0.0
    geographic: bool = False


# Projected systems of the Korean peninsula (EPSG registry).
PRESETS = {
    c.epsg: c
    for c in (
        Crs(5186, "KGD2002 / Central Belt 2010", GRS80, 127.0, 38.0, 1.0, 200000.0, 600000.0),
        Crs(5187, "KGD2002 / East Belt 2010", GRS80, 129.0, 38.0, 1.0, 200000.0, 600000.0),
        Crs(5185, "KGD2002 / West Belt 2010", GRS80, 125.0, 38.0, 1.0, 200000.0, 600000.0),
        Crs(5188, "KGD2002 / East Sea Belt 2010", GRS80, 131.0, 38.0, 1.0, 200000.0, 600000.0),
        Crs(5179, "KGD2002 / Unified CS", GRS80, 127.5, 38.0, 0.9996, 1000000.0, 2000000.0),
        Crs(4326, "WGS 84", WGS84, geographic=True),
    )
}


def crs(epsg: int) -> Crs:
    """The system of an EPSG code: the presets and WGS 84 / UTM."""
    if epsg in PRESETS:
        return PRESETS[epsg]
    if 32601 <= epsg <= 32660 or 32701 <= epsg <= 32760:
        zone, south = epsg % 100, epsg >= 32700
        return Crs(epsg, f"WGS 84 / UTM zone {zone}{'S' if south else 'N'}", WGS84, zone * 6 - 183.0, 0.0, 0.9996, 500000.0, 10000000.0 if south else 0.0)
    raise InputError(f"EPSG:{epsg} is not supported", "invalid_argument")


def is_geographic(epsg: int) -> bool:
    return crs(epsg).geographic


def utm_epsg(lon: Column, lat: Column) -> Column:
    zone = F.pmod(F.floor((lon + 180.0) / 6.0).cast("int"), F.lit(60)) + 1
    return F.when(lat >= 0, 32600 + zone).otherwise(32700 + zone)


def _sum(terms) -> Column:
    return reduce(lambda a, b: a + b, terms)


def _meridian(c: Crs) -> float:
    """Scaled distance from the equator to the system's origin of latitude."""
    p = math.radians(c.lat0)
    t = math.sinh(math.atanh(math.sin(p)) - c.ellipsoid.e * math.atanh(c.ellipsoid.e * math.sin(p)))
    x = math.atan(t)
    return c.scale * c.ellipsoid.radius * (x + sum(a * math.sin(2 * j * x) for j, a in enumerate(series(FORWARD_SERIES, c.ellipsoid.n), 1)))


def forward(lon: Column, lat: Column, epsg: int) -> tuple[Column, Column]:
    """Longitude and latitude in degrees to x and y."""
    c = crs(epsg)
    if c.geographic:
        return lon, lat
    e, r = c.ellipsoid.e, c.scale * c.ellipsoid.radius
    sin = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(sin) - e * F.atanh(e * sin))
    d = F.radians(lon - c.lon0)
    x0, y0 = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    alpha = series(FORWARD_SERIES, c.ellipsoid.n)
    x = y0 + _sum(a * F.cos(2 * j * x0) * F.sinh(2 * j * y0) for j, a in enumerate(alpha, 1))
    y = x0 + _sum(a * F.sin(2 * j * x0) * F.cosh(2 * j * y0) for j, a in enumerate(alpha, 1))
    return c.east + r * x, c.north - _meridian(c) + r * y


def inverse(x: Column, y: Column, epsg: int) -> tuple[Column, Column]:
    """x and y to longitude and latitude in degrees."""
    c = crs(epsg)
    if c.geographic:
        return x, y
    e, r = c.ellipsoid.e, c.scale * c.ellipsoid.radius
    xi, eta = (y - c.north + _meridian(c)) / r, (x - c.east) / r
    beta = series(INVERSE_SERIES, c.ellipsoid.n)
    x0 = xi - _sum(b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(beta, 1))
    y0 = eta - _sum(b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(beta, 1))
    conformal = F.asin(F.sin(x0) / F.cosh(y0))
    target, lat = F.atanh(F.sin(conformal)), conformal
    for _ in range(5):  # isometric latitude, solved for the geodetic one
        lat = F.asin(F.tanh(target + e * F.atanh(e * F.sin(lat))))
    return c.lon0 + F.degrees(F.atan2(F.sinh(y0), F.cos(x0))), F.degrees(lat)


def transform_xy(x: Column, y: Column, source: int, target: int) -> tuple[Column, Column]:
    """Between two systems; the same system gives the values themselves."""
    if source == target:
        return x, y
    return forward(*inverse(x, y, source), target)


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(h))
