"""Geometry and tile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicspark.functions import geo
from civicspark.operators import tiles as tl
from civicspark.plans import roles
from civicspark.plans.registry import Tables, query
from civicspark.plans.roles import ctes

_XI, _ETA = f"(n / {geo.UTM_SCALE!r})", f"((e - 500000) / {geo.UTM_SCALE!r})"
_XI1 = _XI + "".join(f" - {b!r} * sin({2 * j} * {_XI}) * cosh({2 * j} * {_ETA})" for j, b in enumerate(geo.KRUEGER_BETA, 1))
_ETA1 = _ETA + "".join(f" - {b!r} * cos({2 * j} * {_XI}) * sinh({2 * j} * {_ETA})" for j, b in enumerate(geo.KRUEGER_BETA, 1))


@query("geo_reproject_utm33", f"""
WITH p AS (SELECT c_custkey, CAST(300000 + c_custkey * 37 % 30000 AS DOUBLE) e, CAST(5680000 + c_custkey * 91 % 20000 AS DOUBLE) n FROM customer),
q AS (SELECT c_custkey, {_XI1} xi, {_ETA1} eta FROM p), r AS (SELECT *, asin(sin(xi) / cosh(eta)) chi FROM q)
SELECT c_custkey, round(15 + degrees(atan2(sinh(eta), cos(xi))), 6) lon, round(degrees(chi{''.join(f' + {d!r} * sin({2 * j} * chi)' for j, d in enumerate(geo.KRUEGER_DELTA, 1))}), 6) lat FROM r
""")
def geo_reproject_utm33(t: Tables):
    key = F.col("c_custkey")
    point = F.array((300000 + key * 37 % 30000).cast("double"), (5680000 + key * 91 % 20000).cast("double"))
    crs = F.lit('{"type":"name","properties":{"name":"urn:ogc:def:crs:EPSG::25833"}}')
    done = t.customer.select("c_custkey", geo.reproject_coords(F.array(F.array(F.array(point))), geo.epsg_code(crs)).alias("c"))
    spot = F.col("c")[0][0][0]
    return done.select("c_custkey", F.round(spot[0], 6).alias("lon"), F.round(spot[1], 6).alias("lat"))


@query("geom_kind", ctes("features") + """
SELECT dataset_id, feature_id, CASE WHEN geom_type LIKE '%Polygon' THEN 'area' WHEN geom_type LIKE '%Line%' THEN 'line' ELSE 'point' END kind, vertices,
 round(xmin, 6) xmin, round(ymin, 6) ymin, round(xmax, 6) xmax, round(ymax, 6) ymax FROM features
""")
def geom_kind(t: Tables):
    f = tl.with_bbox(roles.features(t))
    return f.select("dataset_id", "feature_id", geo.geom_kind(F.col("geom_type")).alias("kind"), geo.point_count(F.col("coords")).alias("vertices"),
                    *[F.round(c, 6).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


def _tiles_sql(where: str, zooms: list[int]) -> str:
    merc = "(1 - ln(tan(radians({0})) + 1 / cos(radians({0}))) / pi()) / 2 * (2.0 ** z)"
    return f""", zoomed AS (SELECT *, CAST(2.0 AS DOUBLE) ** z AS s FROM features, (SELECT unnest({zooms}) z) WHERE {where}),
placed AS (SELECT *, CAST(greatest(0, ceil((xmin + 180) / 360 * s - 1 - 0.015625)) AS INTEGER) x0, CAST(least(s - 1, floor((xmax + 180) / 360 * s + 0.015625)) AS INTEGER) x1,
 CAST(greatest(0, ceil({merc.format('ymax')} - 1 - 0.015625)) AS INTEGER) y0, CAST(least(s - 1, floor({merc.format('ymin')} + 0.015625)) AS INTEGER) y1 FROM zoomed),
tiled AS (SELECT * , CAST(unnest(range(y0, y1 + 1)) AS INTEGER) y FROM (SELECT *, CAST(unnest(range(x0, x1 + 1)) AS INTEGER) x FROM placed))
"""


@query("tile_detail", ctes("features") + _tiles_sql("TRUE", [14, 16]) + """
SELECT z, x, y, dataset_id, feature_id, feature_type, year, 1 point_count FROM tiled
""")
def tile_detail(t: Tables):
    got = tl.detail_tiles(tl.with_bbox(roles.features(t)), [14, 16])
    return got.select("z", "x", "y", "dataset_id", "feature_id", "feature_type", "year", "point_count")


@query("tile_clusters", ctes("features") + _tiles_sql("geom_type = 'Point'", [8, 11, 13]) + """
SELECT z, x, y, dataset_id, year, CAST(round_even(xmin / (360 / s / 64), 0) AS BIGINT) cell_x, CAST(round_even(ymin / (360 / s / 64), 0) AS BIGINT) cell_y, count(*) point_count,
 round(avg(xmin), 6) lon, round(avg(ymin), 6) lat FROM tiled GROUP BY 1, 2, 3, 4, 5, 6, 7
""")
def tile_clusters(t: Tables):
    got = tl.cluster_tiles(tl.with_bbox(roles.features(t)), [8, 11, 13])
    return got.withColumns({"lon": F.round("lon", 6), "lat": F.round("lat", 6)})


@query("tile_shapes", ctes("features") + _tiles_sql("geom_type <> 'Point'", [6, 8, 10, 12]) + """
SELECT z, x, y, feature_id, geom_type FROM tiled WHERE (xmax - xmin) + (ymax - ymin) > 360 / s / 512
""")
def tile_shapes(t: Tables):
    return tl.visible_shapes(tl.with_bbox(roles.features(t)), [6, 8, 10, 12]).select("z", "x", "y", "feature_id", "geom_type")


@query("tile_shapes_simplified", ctes("features") + _tiles_sql("geom_type <> 'Point'", [10, 12]) + """
SELECT z, x, y, feature_id, vertices FROM tiled WHERE (xmax - xmin) + (ymax - ymin) > 360 / s / 512
""")
def tile_shapes_simplified(t: Tables):
    """The shapes are boxes and lines of two points, from which nothing can go: fewer than four points are no ring."""
    got = tl.shape_tiles(tl.with_bbox(roles.features(t)), [10, 12])
    return got.select("z", "x", "y", "feature_id", geo.point_count(F.col("coords")).alias("vertices"))


#: points on a side of the dense boxes below
_SIDE_POINTS = 8


@query("simplify_dense_boxes", f"""
WITH b AS (SELECT s_suppkey, z, CAST(1 + s_suppkey % 5 AS DOUBLE) / 1000 side, 360.0 / (2.0 ** z) / {tl.SIMPLIFY_PARTS} tol FROM supplier, (SELECT unnest([8, 9, 10, 11, 12]) z))
SELECT s_suppkey, z, CASE WHEN side * sqrt(0.5) > tol THEN 5 ELSE {4 * _SIDE_POINTS + 1} END vertices,
 round(side * CASE WHEN side * sqrt(0.5) > tol THEN 4 ELSE {4 * _SIDE_POINTS} END, 6) spread FROM b
""")
def simplify_dense_boxes(t: Tables):
    """Boxes with points along their sides: only corners stay where the tolerance is below half a diagonal; else too few for a ring
    would stay, so all do. ``spread`` sums x and y over the points."""
    side = (1 + F.col("s_suppkey") % 5) / 1000
    n = _SIDE_POINTS

    def place(i):
        at, edge = (i % n) / F.lit(float(n)), F.floor(i / n) % 4
        x = F.when(edge == 0, at).when(edge == 1, 1.0).when(edge == 2, 1 - at).otherwise(0.0)
        y = F.when(edge == 0, 0.0).when(edge == 1, at).when(edge == 2, 1.0).otherwise(1 - at)
        return F.array(x * side, y * side)

    ring = F.transform(F.sequence(F.lit(0), F.lit(4 * n)), place)
    boxes = t.supplier.select("s_suppkey", F.array(F.array(ring)).alias("coords"),
                              F.explode(F.array(*[F.lit(z) for z in (8, 9, 10, 11, 12)])).alias("z"))
    thin = boxes.withColumn("c", tl.simplify(F.col("coords"), tl.span(F.col("z")) / tl.SIMPLIFY_PARTS)[0][0])
    total = F.aggregate("c", F.lit(0.0), lambda acc, p: acc + p[0] + p[1])
    return thin.select("s_suppkey", "z", F.size("c").alias("vertices"), F.round(total, 6).alias("spread"))


@query("tile_cover", ctes("features") + _tiles_sql("geom_type <> 'Point'", [14, 18]) + """
, cells AS (SELECT z, k, x >> k cell_x, y >> k cell_y, dataset_id, feature_id FROM tiled, (SELECT CAST(unnest(range(0, 19)) AS INTEGER) k) WHERE k <= z
  GROUP BY ALL HAVING count(*) = 4 ** k)
SELECT c.z, c.z - c.k cell_z, c.cell_x, c.cell_y, c.dataset_id, c.feature_id FROM cells c WHERE NOT EXISTS (
 SELECT 1 FROM cells p WHERE p.z = c.z AND p.k = c.k + 1 AND p.cell_x = c.cell_x >> 1 AND p.cell_y = c.cell_y >> 1 AND p.feature_id = c.feature_id)
""")
def tile_cover(t: Tables):
    shapes = tl.with_bbox(roles.features(t)).where(~F.col("geom_type").isin(*geo.POINT_TYPES))
    return tl.cover_tiles(shapes, [14, 18]).select("z", "cell_z", "cell_x", "cell_y", "dataset_id", "feature_id")


@query("tile_asked", ctes("features", "registry") + _tiles_sql("TRUE", [14, 18]) + """
, asked AS (SELECT DISTINCT z, x, y FROM tiled WHERE geom_type = 'Point' AND CAST(feature_id AS INTEGER) % 3 = 0)
SELECT z, x, y, f.feature_id, f.feature_type, f.year, r.family_id, r.title dataset_title, 1 point_count
FROM tiled f JOIN asked USING (z, x, y) JOIN registry r ON r.is_active AND r.dataset_id = CAST(1 + CAST(f.feature_id AS INTEGER) % 200 AS VARCHAR)
""")
def tile_asked(t: Tables):
    """Features of active datasets in the tiles that every third customer lies in."""
    own = roles.features(t).withColumn("dataset_id", (1 + F.col("feature_id").cast("int") % 200).cast("string"))
    boxed = tl.with_bbox(own)
    asked = tl.assign_tiles(boxed.where((F.col("geom_type") == "Point") & (F.col("feature_id").cast("int") % 3 == 0)), [14, 18])
    cover = tl.cover_tiles(tl.of_active(boxed, roles.registry(t)), [14, 18])
    got = tl.features_of(cover, asked)
    return got.select("z", "x", "y", "feature_id", "feature_type", "year", "family_id", "dataset_title", F.lit(1).alias("point_count"))
