"""Coordinate arithmetic on columns: UTM to degrees, web-mercator tiles, shape helpers."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EARTH_RADIUS_M = 6371008.8  # mean radius; areas are spherical, not on the ellipsoid
POLYGON_TYPES = ("Polygon", "MultiPolygon")
LINE_TYPES = ("LineString", "MultiLineString")
POINT_TYPES = ("Point", "MultiPoint")

# fixed values: GRS80 ellipsoid and the UTM projection constants
_A, _INV_F = 6378137.0, 298.257222101
_K0, _FALSE_EASTING = 0.9996, 500000.0
_N = (1 / _INV_F) / (2 - 1 / _INV_F)
_RECT_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# fixed values: third-order Krueger series coefficients (inverse, and conformal to geodetic)
KRUEGER_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96,
    _N**2 / 48 + _N**3 / 15,
    17 * _N**3 / 480,
)
KRUEGER_DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3,
    7 * _N**2 / 3 - 8 * _N**3 / 5,
    56 * _N**3 / 15,
)
UTM_SCALE = _K0 * _RECT_RADIUS


def utm_to_lonlat(easting: Column, northing: Column, zone: int = 33) -> tuple[Column, Column]:
    """Inverse transverse Mercator (northern hemisphere) as pure column arithmetic."""
    xi = northing / UTM_SCALE
    eta = (easting - _FALSE_EASTING) / UTM_SCALE
    xi1, eta1 = xi, eta
    for j, b in enumerate(KRUEGER_BETA, start=1):
        xi1 = xi1 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    phi = chi
    for j, d in enumerate(KRUEGER_DELTA, start=1):
        phi = phi + d * F.sin(2 * j * chi)
    lon0 = zone * 6 - 183
    return F.lit(float(lon0)) + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))), F.degrees(phi)


def epsg_code(crs: Column) -> Column:
    """EPSG number named in a crs text (short or URN form); 4326 when absent."""
    return F.coalesce(
        F.nullif(F.regexp_extract(crs, r"(?i)EPSG:{1,2}(\d+)", 1), F.lit("")).cast("int"), F.lit(4326)
    )


def map_points(coords: Column, fn) -> Column:
    """Apply ``fn(point) -> point`` at the innermost level of a coordinate array."""
    return F.transform(
        coords, lambda poly: F.transform(poly, lambda ring: F.transform(ring, fn))
    )


def reproject_coords(coords: Column, epsg: Column) -> Column:
    """UTM zones 32N and 33N become lon/lat; other systems pass unchanged."""

    def to_degrees(zone):
        return lambda p: F.array(*utm_to_lonlat(p[0], p[1], zone))

    return (
        F.when(epsg == 25833, map_points(coords, to_degrees(33)))
        .when(epsg == 25832, map_points(coords, to_degrees(32)))
        .otherwise(coords)
    )


def coords_from_json(geom_type: Column, text: Column) -> Column:
    """GeoJSON coordinates of any simple or multi type as one four-level array (a Point is one
    polygon with one ring with one point)."""
    return (
        F.when(geom_type == "Point", F.array(F.array(F.array(F.from_json(text, "array<double>")))))
        .when(geom_type.isin("MultiPoint", "LineString"),
              F.array(F.array(F.from_json(text, "array<array<double>>"))))
        .when(geom_type.isin("MultiLineString", "Polygon"),
              F.array(F.from_json(text, "array<array<array<double>>>")))
        .when(geom_type == "MultiPolygon", F.from_json(text, "array<array<array<array<double>>>>"))
    )


def coords_to_json(geom_type: Column, coords: Column) -> Column:
    return (
        F.when(geom_type == "Point", F.to_json(coords[0][0][0]))
        .when(geom_type.isin("MultiPoint", "LineString"), F.to_json(coords[0][0]))
        .when(geom_type.isin("MultiLineString", "Polygon"), F.to_json(coords[0]))
        .otherwise(F.to_json(coords))
    )


def force_2d(coords: Column) -> Column:
    return map_points(coords, lambda p: F.slice(p, 1, 2))


def multi_type(geom_type: Column) -> Column:
    return F.when(geom_type.startswith("Multi"), geom_type).otherwise(F.concat(F.lit("Multi"), geom_type))


def geom_kind(geom_type: Column) -> Column:
    return (
        F.when(geom_type.isin(*POLYGON_TYPES), "area")
        .when(geom_type.isin(*LINE_TYPES), "line")
        .otherwise("point")
    )


def _points(coords: Column) -> Column:
    return F.flatten(F.flatten(coords))


def point_count(coords: Column) -> Column:
    return F.size(_points(coords))


def bbox(coords: Column) -> tuple[Column, Column, Column, Column]:
    xs = F.transform(_points(coords), lambda p: p[0])
    ys = F.transform(_points(coords), lambda p: p[1])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def points_centroid(coords: Column) -> tuple[Column, Column]:
    """Mean position of all vertices (exact for point shapes)."""
    pts = _points(coords)
    total = lambda i: F.aggregate(pts, F.lit(0.0), lambda s, p: s + p[i])
    return total(0) / F.size(pts), total(1) / F.size(pts)


def spherical_area_m2(coords: Column) -> Column:
    """Area on the mean sphere; holes subtract. Within about 0.5 % of the ellipsoid."""

    def ring_area(ring: Column) -> Column:
        steps = F.sequence(F.lit(0), F.size(ring) - 2)
        edge = F.transform(
            steps,
            lambda i: F.radians(ring[i + 1][0] - ring[i][0])
            * (2 + F.sin(F.radians(ring[i][1])) + F.sin(F.radians(ring[i + 1][1]))),
        )
        return F.abs(F.aggregate(edge, F.lit(0.0), lambda s, e: s + e)) * (EARTH_RADIUS_M**2 / 2)

    def poly_area(poly: Column) -> Column:
        areas = F.transform(poly, ring_area)
        return 2 * areas[0] - F.aggregate(areas, F.lit(0.0), lambda s, a: s + a)

    return F.aggregate(F.transform(coords, poly_area), F.lit(0.0), lambda s, a: s + a)


def tile_x(lon: Column, z) -> Column:
    """Fractional tile column; callers floor it."""
    return (lon + 180.0) / 360.0 * F.pow(F.lit(2.0), z)


def tile_y(lat: Column, z) -> Column:
    rad = F.radians(lat)
    merc = F.log(F.tan(rad) + 1 / F.cos(rad))
    return (1 - merc / math.pi) / 2 * F.pow(F.lit(2.0), z)
