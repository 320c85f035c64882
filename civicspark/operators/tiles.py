"""Map tiles as a batch job: assignment, quadtree cover, detail rows, clusters, simplified shapes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from civicspark.functions import geo
from civicspark.operators.state import top_per_key

DETAIL_ZOOM = 14  # fixed value: from here on single features, below clusters
TILE_MARGIN = 0.015625  # fixed value: buffer of a tile, as a share of its width
GRID_PARTS, SIMPLIFY_PARTS, DROP_PARTS = 64, 256, 512  # fixed values: divisors of the tile span


def span(z: Column) -> Column:
    """Width of a tile in degrees."""
    return F.lit(360.0) / F.pow(F.lit(2.0), z)


def _boxed(features: DataFrame, zooms: list[int]) -> DataFrame:
    """Each feature once per zoom, with the range of tiles (_x0.._x1, _y0.._y1) whose buffered envelope meets its box."""
    z = F.col("z")
    last = F.pow(F.lit(2.0), z) - 1

    def first_tile(edge: Column) -> Column:
        return F.greatest(F.lit(0.0), F.ceil(edge - 1 - TILE_MARGIN)).cast("int")

    def last_tile(edge: Column) -> Column:
        return F.least(last, F.floor(edge + TILE_MARGIN)).cast("int")

    zoomed = features.withColumn("z", F.explode(F.array(*[F.lit(int(v)) for v in zooms])))
    placed = zoomed.withColumns({
        "_x0": first_tile(geo.tile_x(F.col("xmin"), z)), "_x1": last_tile(geo.tile_x(F.col("xmax"), z)),
        "_y0": first_tile(geo.tile_y(F.col("ymax"), z)), "_y1": last_tile(geo.tile_y(F.col("ymin"), z))})
    return placed.where("_x1 >= _x0 and _y1 >= _y0")


def assign_tiles(features: DataFrame, zooms: list[int]) -> DataFrame:
    """One row per feature, zoom and tile whose buffered envelope meets the feature's box.

    Needs xmin, ymin, xmax, ymax. Tiles come from arithmetic on the box, so no join with tile bounds
    is needed; a point meets one tile, or up to four at a corner. A large area meets as many tiles as it covers:
    where only some tiles are asked for, :func:`features_of` finds them by :func:`cover_tiles`."""
    return _boxed(features, zooms).withColumn("x", F.explode(F.sequence("_x0", "_x1"))).withColumn(
        "y", F.explode(F.sequence("_y0", "_y1"))).drop("_x0", "_x1", "_y0", "_y1")


def cover_tiles(features: DataFrame, zooms: list[int]) -> DataFrame:
    """The tiles of :func:`assign_tiles` as disjoint quadtree cells: (cell_z, cell_x, cell_y) stands for all tiles of
    zoom z inside that cell. A cell is taken where it lies in the range of tiles and its parent does not, so
    cells are coarse inside an area and tiles only at its edge: at most about 4 (width + height) rows, not their product."""
    steps = _boxed(features, zooms).withColumn("_k", F.explode(F.sequence(F.lit(0), "z")))

    def inside(lo: str, hi: str, k: str) -> tuple[Column, Column]:
        """First and last cell of 2^k tiles that lies wholly in the range."""
        return F.expr(f"-shiftright(-{lo}, {k})"), F.expr(f"shiftright({hi} + 1, {k}) - 1")

    for axis in "xy":
        near, far = inside(f"_{axis}0", f"_{axis}1", "_k")
        up_near, up_far = inside(f"_{axis}0", f"_{axis}1", "_k + 1")
        steps = steps.withColumns({f"_{axis}a": near, f"_{axis}b": far, f"_{axis}c": 2 * up_near, f"_{axis}d": 2 * up_far + 1})
    steps = steps.where("_xa <= _xb and _ya <= _yb")
    # the hole [c, d] belongs to parents; without one the first strip takes the whole range
    hole = F.expr("_xc < _xd and _yc < _yd")
    strips = F.expr("""array(
        named_struct('x0', _xa, 'x1', if(_hole, _xc - 1, _xb), 'y0', _ya, 'y1', _yb),
        named_struct('x0', _xd + 1, 'x1', if(_hole, _xb, _xd), 'y0', _ya, 'y1', _yb),
        named_struct('x0', _xc, 'x1', if(_hole, _xd, _xc - 1), 'y0', _ya, 'y1', _yc - 1),
        named_struct('x0', _xc, 'x1', if(_hole, _xd, _xc - 1), 'y0', _yd + 1, 'y1', _yb))""")
    cut = steps.withColumn("_hole", hole).withColumn("_s", F.explode(F.filter(strips, lambda s: (s.x0 <= s.x1) & (s.y0 <= s.y1))))
    cells = cut.withColumn("cell_x", F.explode(F.sequence("_s.x0", "_s.x1"))).withColumn(
        "cell_y", F.explode(F.sequence("_s.y0", "_s.y1"))).withColumn("cell_z", F.col("z") - F.col("_k"))
    return cells.drop("_k", "_s", "_hole", *[f"_{axis}{e}" for axis in "xy" for e in "01abcd"])


def features_of(cover: DataFrame, tiles: DataFrame) -> DataFrame:
    """Features of the asked tiles (z, x, y) by equality with the cells above each tile. Cells of a feature are
    disjoint, so a feature comes once per tile."""
    asked = tiles.select("z", "x", "y").distinct().withColumn("_k", F.explode(F.sequence(F.lit(0), "z")))
    above = asked.select("z", "x", "y", (F.col("z") - F.col("_k")).alias("cell_z"),
                         F.expr("shiftright(x, _k)").alias("cell_x"), F.expr("shiftright(y, _k)").alias("cell_y"))
    return cover.join(above, ["z", "cell_z", "cell_x", "cell_y"]).drop("cell_z", "cell_x", "cell_y")


def of_active(features: DataFrame, datasets: DataFrame) -> DataFrame:
    """Features of active datasets, with the family and the title of their dataset."""
    known = datasets.where("is_active").select("dataset_id", "family_id", F.col("title").alias("dataset_title"))
    return features.join(known, "dataset_id")


def with_bbox(features: DataFrame) -> DataFrame:
    xmin, ymin, xmax, ymax = geo.bbox(F.col("coords"))
    return features.withColumns({"xmin": xmin, "ymin": ymin, "xmax": xmax, "ymax": ymax})


def _capped(tiles: DataFrame, cap: int | None) -> DataFrame:
    """All features, or the first ``cap`` of each tile for a reader that asks for it. Ranking runs per (tile, salt) first, so a tile that holds a
    third of all features is spread over tasks."""
    if cap is None:
        return tiles
    salt = F.pmod(F.xxhash64("dataset_id", "feature_id"), F.lit(64))
    return top_per_key(tiles, ["z", "x", "y"], [F.asc("dataset_id"), F.asc("feature_id")], cap, [salt])


def chosen_layers(features: DataFrame, datasets: list[str] | None, families: list[str] | None) -> DataFrame:
    """Features of the named datasets or families; without names all of them."""
    if datasets is None and families is None:
        return features
    wanted = F.col("dataset_id").isin(*(datasets or []))
    return features.where(wanted | F.col("family_id").isin(*families) if families else wanted)


def detail_tiles(features: DataFrame, zooms: list[int], datasets: list[str] | None = None,
                 families: list[str] | None = None, cap: int | None = None) -> DataFrame:
    """Single features per tile for zooms from the detail zoom on."""
    if any(v < DETAIL_ZOOM for v in zooms):
        raise ValueError(f"detail tiles start at zoom {DETAIL_ZOOM}")
    chosen = chosen_layers(features, datasets, families)
    return _capped(assign_tiles(chosen, zooms), cap).withColumn("point_count", F.lit(1))


def cluster_tiles(features: DataFrame, zooms: list[int], group=("dataset_id", "year")) -> DataFrame:
    """Points of a tile clustered on a grid per dataset and year: count and mean position. Counts and
    sums combine before the shuffle, so a crowded cell is no hot spot."""
    lon, lat = geo.points_centroid(F.col("coords"))
    points = features.where(F.col("geom_type").isin(*geo.POINT_TYPES)).select(
        *group, lon.alias("lon"), lat.alias("lat"), "xmin", "ymin", "xmax", "ymax")
    grid = span(F.col("z")) / GRID_PARTS
    return assign_tiles(points, zooms).groupBy(
        "z", "x", "y", *group, F.rint(F.col("lon") / grid).cast("bigint").alias("cell_x"), F.rint(F.col("lat") / grid).cast("bigint").alias("cell_y"),
    ).agg(F.count(F.lit(1)).alias("point_count"), F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))


def visible_shapes(features: DataFrame, zooms: list[int]) -> DataFrame:
    """Lines and areas per tile, without those smaller than about a pixel."""
    size = (F.col("xmax") - F.col("xmin")) + (F.col("ymax") - F.col("ymin"))
    shapes = features.where(~F.col("geom_type").isin(*geo.POINT_TYPES))
    return assign_tiles(shapes, zooms).where(size > span(F.col("z")) / DROP_PARTS)


def shape_tiles(features: DataFrame, zooms: list[int], cap: int | None = None) -> DataFrame:
    """Visible shapes simplified to the resolution of their zoom."""
    kept = _capped(visible_shapes(features, zooms), cap)
    return kept.withColumn("coords", simplify(F.col("coords"), span(F.col("z")) / SIMPLIFY_PARTS))


def _kept(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, tolerance: np.ndarray) -> np.ndarray:
    """Douglas-Peucker over all lines [start, end) at once: each pass measures every point between the ends of every open
    chord and cuts the chords whose farthest point is beyond the tolerance. Marks the points to keep."""
    keep = np.zeros(len(points), bool)
    filled = ends > starts
    first, last, limit = starts[filled], ends[filled] - 1, tolerance[filled]
    keep[first] = keep[last] = True
    while True:
        wide = last - first > 1
        first, last, limit = first[wide], last[wide], limit[wide]
        if not len(first):
            return keep
        inner = last - first - 1
        heads = np.cumsum(inner) - inner
        chord_of = np.repeat(np.arange(len(first)), inner)
        at = np.arange(len(chord_of)) - heads[chord_of] + first[chord_of] + 1
        chord = points[last] - points[first]
        length = np.hypot(chord[:, 0], chord[:, 1])
        offset = points[at] - points[first][chord_of]
        across = np.abs(offset[:, 0] * chord[chord_of, 1] - offset[:, 1] * chord[chord_of, 0])
        away = np.where(length[chord_of] == 0, np.hypot(offset[:, 0], offset[:, 1]),
                        across / np.where(length == 0, 1.0, length)[chord_of])
        away[np.isnan(away)] = -1.0  # a point without a place is never the farthest
        worst = np.maximum.reduceat(away, heads)
        hits = np.flatnonzero(away == worst[chord_of])
        far = at[hits[np.unique(chord_of[hits], return_index=True)[1]]]
        cut = worst > limit
        first, last, far, limit = first[cut], last[cut], far[cut], limit[cut]
        keep[far] = True
        first, last, limit = np.concatenate((first, far)), np.concatenate((far, last)), np.concatenate((limit, limit))


def _owner(offsets: np.ndarray, items: int) -> np.ndarray:
    """List that holds each item, by the offsets of the lists."""
    return np.clip(np.searchsorted(offsets, np.arange(items), "right") - 1, 0, len(offsets) - 2)


@F.arrow_udf(T.ArrayType(T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))))
def _simplify_batch(coords: pa.Array, tolerance: pa.Array) -> pa.Array:
    """All rings of the batch from its flat coordinate buffers; rings keep at least four points."""
    parts, rings, places = coords.values, coords.values.values, coords.values.values.values
    by_shape, by_part, by_ring, by_place = (x.offsets.to_numpy() for x in (coords, parts, rings, places))
    numbers = places.values.to_numpy(zero_copy_only=False).astype(float)
    # places have at least two numbers; any further ones are dropped
    points = np.stack([numbers[by_place[:-1]], numbers[by_place[:-1] + 1]], axis=1)
    starts, ends = by_ring[:-1].astype(np.int64), by_ring[1:].astype(np.int64)
    shape_of = _owner(by_shape, len(parts))[_owner(by_part, len(rings))]
    keep = _kept(points, starts, ends, tolerance.to_numpy(zero_copy_only=False).astype(float)[shape_of])
    before = np.concatenate(([0], np.cumsum(keep)))
    long = ends - starts >= 4
    tiny = np.zeros(len(rings), bool)
    tiny[long] = (points[starts[long]] == points[ends[long] - 1]).all(axis=1)
    tiny &= before[ends] - before[starts] < 4
    marks = np.zeros(len(points) + 1, np.int64)
    np.add.at(marks, starts[tiny], 1)
    np.add.at(marks, ends[tiny], -1)
    keep |= np.cumsum(marks[:-1]) > 0
    before = np.concatenate(([0], np.cumsum(keep)))
    kept = points[keep]
    out = pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1) * 2, pa.int32()), pa.array(kept.ravel()))
    for offsets in (before[by_ring], by_part, by_shape):
        out = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), out)
    return out


def simplify(coords: Column, tolerance: Column) -> Column:
    """Shapes thinned to a tolerance, Arrow batch by batch; empty shapes pass unchanged.

    A stand-in takes their place on the way to Python: Arrow cannot hand over a batch of nested
    lists that are all empty."""
    filled = F.coalesce(geo.point_count(coords) > 0, F.lit(False))
    origin = F.array(F.lit(0.0), F.lit(0.0))
    stand_in = F.array(F.array(F.array(origin, origin)))
    return F.when(filled, _simplify_batch(F.when(filled, coords).otherwise(stand_in), tolerance)).otherwise(coords)
