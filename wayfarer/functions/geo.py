"""Geodesy and the grid as Column expressions; no UDF."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK, CELL = 1000, 40
EARTH_RADIUS = 6_371_008.8
#: World metres: east of this easting, south of this northing (UTM zone 50 south).
ORIGIN_EASTING, ORIGIN_NORTHING = 287_500.0, 9_065_500.0
AXIS, FLATTENING, SCALE = 6_378_137.0, 1 / 298.257223563, 0.9996
FALSE_EASTING, FALSE_NORTHING, MERIDIAN = 500_000.0, 10_000_000.0, 117.0

# Coefficients of the Krueger series to the sixth order in the third flattening n, as published by
# C. F. F. Karney, Transverse Mercator with an accuracy of a few nanometers (2011). Row k holds the factors of n**k, n**(k+1), ...
_ALPHA = [
    [1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800],
    [13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360],
    [61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440],
    [49561 / 161280, -179 / 168, 6601661 / 7257600],
    [34729 / 80640, -3418889 / 1995840],
    [212378941 / 319334400],
]
_BETA = [
    [1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800],
    [1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720],
    [17 / 480, -37 / 840, -209 / 4480, 5569 / 90720],
    [4397 / 161280, -11 / 504, -830251 / 7257600],
    [4583 / 161280, -108847 / 3991680],
    [20648693 / 638668800],
]
_DELTA = [
    [2, -2 / 3, -2, 116 / 45, 26 / 45, -2854 / 675],
    [7 / 3, -8 / 5, -227 / 45, 2704 / 315, 2323 / 945],
    [56 / 15, -136 / 35, -1262 / 105, 73814 / 2835],
    [4279 / 630, -332 / 35, -399572 / 14175],
    [4174 / 315, -144838 / 6237],
    [601676 / 22275],
]
_N = FLATTENING / (2 - FLATTENING)


def _series(table: list[list[float]]) -> list[float]:
    return [sum(c * _N ** (k + i) for i, c in enumerate(row)) for k, row in enumerate(table, 1)]


ALPHA, BETA, DELTA = map(_series, (_ALPHA, _BETA, _DELTA))
RADIUS = SCALE * AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
CONFORMAL = 2 * math.sqrt(_N) / (1 + _N)


def world_of(lon: float, lat: float) -> tuple[float, float]:
    """lon_lat_to_world() of one place, in plain numbers."""
    phi, d = math.radians(lat), math.radians(lon - MERIDIAN)
    tau = math.sinh(math.atanh(math.sin(phi)) - CONFORMAL * math.atanh(CONFORMAL * math.sin(phi)))
    xi, eta = math.atan2(tau, math.cos(d)), math.asinh(math.sin(d) / math.hypot(tau, math.cos(d)))
    east = eta + sum(a * math.cos(2 * k * xi) * math.sinh(2 * k * eta) for k, a in enumerate(ALPHA, 1))
    north = xi + sum(a * math.sin(2 * k * xi) * math.cosh(2 * k * eta) for k, a in enumerate(ALPHA, 1))
    return FALSE_EASTING - ORIGIN_EASTING + RADIUS * east, ORIGIN_NORTHING - FALSE_NORTHING - RADIUS * north


def lon_lat_of(x: float, z: float) -> tuple[float, float]:
    """world_to_lon_lat() of one place, in plain numbers."""
    xi, eta = (ORIGIN_NORTHING - FALSE_NORTHING - z) / RADIUS, (x + ORIGIN_EASTING - FALSE_EASTING) / RADIUS
    a = xi - sum(f * math.sin(2 * k * xi) * math.cosh(2 * k * eta) for k, f in enumerate(BETA, 1))
    b = eta - sum(f * math.cos(2 * k * xi) * math.sinh(2 * k * eta) for k, f in enumerate(BETA, 1))
    chi = math.asin(math.sin(a) / math.cosh(b))
    phi = chi + sum(f * math.sin(2 * k * chi) for k, f in enumerate(DELTA, 1))
    return MERIDIAN + math.degrees(math.atan2(math.sinh(b), math.cos(a))), math.degrees(phi)


def equirectangular(lon: Column, lat: Column, lon0: float, lat0: float) -> Column:
    """struct(x, z) around a place: a degree has a fixed length there, shorter east to west."""
    return F.struct(((lon - lon0) * (111_320.0 * math.cos(math.radians(lat0)))).alias("x"), ((lat - lat0) * -110_574.0).alias("z"))


def hypot(x: Column, z: Column) -> Column:
    return F.sqrt(x * x + z * z)


def lon_lat_to_world(lon: Column, lat: Column) -> Column:
    """struct(x, z) in metres, z to the south."""
    phi, d = F.radians(lat), F.radians(lon - MERIDIAN)
    tau = F.sinh(F.atanh(F.sin(phi)) - CONFORMAL * F.atanh(CONFORMAL * F.sin(phi)))
    xi, eta = F.atan2(tau, F.cos(d)), F.asinh(F.sin(d) / hypot(tau, F.cos(d)))
    east, north = eta, xi
    for k, a in enumerate(ALPHA, 1):
        east += a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        north += a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return F.struct((FALSE_EASTING - ORIGIN_EASTING + RADIUS * east).alias("x"), (ORIGIN_NORTHING - FALSE_NORTHING - RADIUS * north).alias("z"))


def world_to_lon_lat(x: Column, z: Column) -> Column:
    """struct(lon, lat) in degrees."""
    xi, eta = (ORIGIN_NORTHING - FALSE_NORTHING - z) / RADIUS, (x + ORIGIN_EASTING - FALSE_EASTING) / RADIUS
    a, b = xi, eta
    for k, f in enumerate(BETA, 1):
        a -= f * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        b -= f * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    chi = F.asin(F.sin(a) / F.cosh(b))
    phi = chi
    for k, f in enumerate(DELTA, 1):
        phi += f * F.sin(2 * k * chi)
    return F.struct((MERIDIAN + F.degrees(F.atan2(F.sinh(b), F.cos(a)))).alias("lon"), F.degrees(phi).alias("lat"))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS * F.asin(F.sqrt(h))


def cell_of(v: Column, size: float = CHUNK) -> Column:
    """Half-open cells; floors towards minus infinity."""
    return F.floor(v / size).cast("int")


def chunk_of(x: Column, z: Column) -> Column:
    return F.struct(cell_of(x).alias("i"), cell_of(z).alias("j"))


def chunk_centre(i: Column) -> Column:
    return (i + 0.5) * CHUNK


def chunk_key(i: Column, j: Column) -> Column:
    return F.concat(F.lit("x"), i, F.lit("_z"), j)


def parse_chunk_key(key: Column) -> Column:
    """struct(i, j); raises on any other spelling."""
    pattern = r"^x(0|-?[1-9]\d*)_z(0|-?[1-9]\d*)$"
    part = lambda n: F.regexp_extract(key, pattern, n).cast("int")
    return F.when(key.rlike(pattern), F.struct(part(1).alias("i"), part(2).alias("j"))).otherwise(F.raise_error(F.concat(F.lit("not a chunk key: "), key)))


def point_to_segment(px: Column, pz: Column, ax: Column, az: Column, bx: Column, bz: Column) -> Column:
    """struct(distance, x, z) of the nearest point on the segment; of no length, its end."""
    dx, dz = bx - ax, bz - az
    length2 = dx * dx + dz * dz
    t = F.when(length2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (pz - az) * dz) / length2))).otherwise(F.lit(0.0))
    x, z = ax + dx * t, az + dz * t
    return F.struct(hypot(px - x, pz - z).alias("distance"), x.alias("x"), z.alias("z"))


def heading(ax: Column, az: Column, bx: Column, bz: Column) -> Column:
    """Clockwise from north; pi for a segment of no length, as IEEE has it for a negative zero."""
    return F.when((ax == bx) & (az == bz), F.lit(math.pi)).otherwise(F.atan2(bx - ax, az - bz))


def shortest_turn(delta: Column) -> Column:
    return F.pmod(delta + math.pi, F.lit(2 * math.pi)) - math.pi


def ring_distance(i: Column, j: Column, x: Column, z: Column) -> Column:
    return F.greatest(F.abs(i - cell_of(x)), F.abs(j - cell_of(z)))


def distance_to_chunk(i: Column, j: Column, x: Column, z: Column) -> Column:
    off = lambda v, c: F.greatest(c * CHUNK - v, F.lit(0.0), v - (c + 1) * CHUNK)
    return hypot(off(x, i), off(z, j))


def off_heading(i: Column, j: Column, x: Column, z: Column, direction: Column) -> Column:
    """1 - cos of the angle between the heading and the way to the chunk's centre; 0 at the centre."""
    dx, dz = chunk_centre(i) - x, chunk_centre(j) - z
    length = hypot(dx, dz)
    return F.when(length > 0, 1 - (dx * F.sin(direction) - dz * F.cos(direction)) / length).otherwise(F.lit(0.0))


def keeps_origin(dx: Column, dz: Column, drift: float = 2000.0) -> Column:
    return hypot(dx, dz) < drift


def to_local(x: Column, z: Column, i: Column, j: Column) -> Column:
    """struct(x, z) from the centre of a chunk."""
    return F.struct((x - chunk_centre(i)).alias("x"), (z - chunk_centre(j)).alias("z"))


def to_render(x: Column, z: Column, origin_x: Column, origin_z: Column) -> Column:
    """struct(x, z) from the place that space is drawn from."""
    return F.struct((x - origin_x).alias("x"), (z - origin_z).alias("z"))


def chunk_file(key: Column, file: Column | str) -> Column:
    return F.concat_ws("/", key, F.lit(file) if isinstance(file, str) else file)


#: Where rides start, the way they face and the road there.
RIDE_START, RIDE_HEADING, RIDE_ROAD = world_of(115.1580183, -8.64443), 0.0, "Jalan Raya Canggu"
