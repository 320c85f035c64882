"""JSON records with or without an envelope, GeoJSON, and the curated registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from civicspark.functions import geo
from civicspark.session import settled, work_path
from civicspark.sources import splits

ENVELOPES = ("values", "data")  # fixed values

FEATURE_FIELDS = "type:string, id:string, geometry:struct<type:string, coordinates:string>, properties:string"
# one schema fits a collection and a bare feature, so arrays of features and feature lines work too
FEATURE = "type string, id string, geometry struct<type:string, coordinates:string>, properties string"
GEOJSON = f"type string, crs string, features array<struct<{FEATURE_FIELDS}>>, id string, " \
          "geometry struct<type:string, coordinates:string>, properties string"


def read_records(spark: SparkSession, path: str, lines: bool = False, order: str | None = None) -> DataFrame:
    """Records of a list, of a 'values' or 'data' envelope, or a single object; cells stay text.

    A large file is cut into records by many tasks; if a document has both envelopes, 'values' counts. ``lines``
    reads one document per line instead. ``order`` names a column that rises along a file."""
    if not lines:
        found, _ = splits.json_records(spark, path, ENVELOPES)
        found = settled(found, "records")
        preferred = found.where(F.col("key") == ENVELOPES[0]).select(F.col("file").alias("p_file")).distinct()
        found = found.join(F.broadcast(preferred), F.col("file") == F.col("p_file"), "left")  # a row per file at most
        found = found.where(F.col("p_file").isNull() | (F.col("key") != ENVELOPES[1]))
        folder = work_path(spark, "record-lines")
        found.select((F.col("start") + F.col("seq")).alias("at"), "text").select(
            F.concat(F.lit('{"r":'), "text", F.lit(',"at":'), F.col("at").cast("string"), F.lit("}")).alias("value")).write.text(folder)
        df = spark.read.option("primitivesAsString", True).json(folder)
        if not df.columns:
            return spark.createDataFrame([], order + " long") if order else df
        return df.select("r.*", *([F.col("at").cast("long").alias(order)] if order else []))
    df = spark.read.option("primitivesAsString", True).json(path)
    if order:
        df = df.withColumn(order, F.monotonically_increasing_id())
    boxed = [c for c in ENVELOPES if c in df.columns and isinstance(df.schema[c].dataType, T.ArrayType)]
    if not boxed:
        return df
    # arrays of different record shapes cannot be merged in one column, so they are read one by one
    kinds = {df.schema[c].dataType.simpleString() for c in boxed}
    items = F.coalesce(*boxed) if len(kinds) == 1 else F.col(boxed[0])
    exploded = df.select(F.explode(items).alias("record"))
    if order:
        exploded = exploded.withColumn(order, F.monotonically_increasing_id())
    is_struct = isinstance(exploded.schema["record"].dataType, T.StructType)
    return exploded.select("record.*", *([order] if order else [])) if is_struct else exploded


def read_geojson(spark: SparkSession, path: str, lines: bool = False, order: str | None = None) -> DataFrame:
    """Features in lon/lat: (feature_id, geom_type, coords, properties, epsg). UTM input is reprojected,
    other systems pass unchanged. A large collection is cut into features by many tasks; ``lines`` reads one feature
    or collection per line instead. ``order`` names a column that rises along a file."""
    if lines:
        docs = spark.read.schema(GEOJSON).json(path)
        single = F.array(F.struct("type", "id", "geometry", "properties"))
        feats = docs.select(geo.epsg_code(F.col("crs")).alias("epsg"), F.inline(F.coalesce("features", single)))
        feats = feats.withColumn(order, F.monotonically_increasing_id()) if order else feats
        return geojson_features(feats, order)
    found, members = splits.json_records(spark, path, ("features",))
    systems = members.where(F.col("name") == "{crs").groupBy(F.col("file").alias("c_file")).agg(F.max("value").alias("crs"))
    found = found.join(F.broadcast(systems), F.col("file") == F.col("c_file"), "left")  # a row per file at most
    feats = found.select(F.from_json("text", FEATURE).alias("f"), geo.epsg_code(F.col("crs")).alias("epsg"), (F.col("start") + F.col("seq")).alias("at"))
    feats = feats.where("f.type = 'Feature' or f.geometry is not null")
    return geojson_features(feats.select("f.*", "epsg", F.col("at").alias(order or "_at")), order)


def geojson_features(feats: DataFrame, order: str | None = None) -> DataFrame:
    kind = F.col("geometry.type")
    coords = geo.coords_from_json(kind, F.col("geometry.coordinates"))
    return feats.select(
        F.col("id").alias("feature_id"), kind.alias("geom_type"),
        geo.reproject_coords(coords, F.col("epsg")).alias("coords"), "properties", "epsg", *([order] if order else []))


def feature_json(properties: list[str]):
    """GeoJSON feature text of a row with geom_type and coords; ``properties`` names its columns."""
    geometry = F.concat(F.lit('{"type":"'), F.col("geom_type"), F.lit('","coordinates":'),
                        geo.coords_to_json(F.col("geom_type"), F.col("coords")), F.lit("}"))
    props = F.to_json(F.struct(*properties), {"ignoreNullFields": "false"})
    return F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), props, F.lit("}"))


def write_geojson(df: DataFrame, path: str, properties: list[str]) -> None:
    """One feature per line, so the output stays splittable."""
    df.select(feature_json(properties).alias("value")).write.mode("overwrite").text(path)


# --- curated registries --------------------------------------------------------------------------------

_MEMBER = "struct<dataset_id:string, year:int, title:string>"
_HINT = "struct<spatial_unit:string, spatial_key_column:string, skip_columns:array<string>, year:int>"


def read_families(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(members, hints) of the family registry."""
    docs = spark.read.schema(
        f"families array<struct<family_id:string, title:string, members:array<{_MEMBER}>>>, dataset_hints map<string, {_HINT}>"
    ).option("multiLine", not lines).json(path)
    families = docs.select(F.inline("families"))
    members = families.select("family_id", F.col("title").alias("family_title"), F.inline("members")).select(
        "family_id", "family_title", "dataset_id", F.col("year").alias("family_year"), "title")
    hints = docs.select(F.explode("dataset_hints").alias("dataset_id", "h")).select("dataset_id", "h.*")
    return members, hints


def read_elections(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(elections, routes, sources): definitions with party order, dataset levels, share datasets."""
    docs = spark.read.schema(
        "elections array<struct<election_id:string, title:string, election_type:string, date:string, year:int, vote_mode:string, "
        "parties:array<string>, datasets:map<string, struct<level:string>>>>, kleinraeumig_sources map<string, string>"
    ).option("multiLine", True).json(path)
    elections = docs.select(F.inline("elections"))
    routes = elections.select("election_id", "vote_mode", F.explode("datasets").alias("dataset_id", "s")).select(
        "dataset_id", "election_id", "vote_mode", F.col("s.level").alias("level"))
    sources = docs.select(F.explode("kleinraeumig_sources").alias("dataset_id", "election_type"))
    return elections.drop("datasets"), routes, sources


def read_parties(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(
        "parties array<struct<key:string, name:string, position:double, color:string, aliases:array<string>>>"
    ).option("multiLine", True).json(path).select(F.inline("parties"))


def read_indicators(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(indicators, mapping)."""
    rows = spark.read.schema(
        "indicators array<struct<indicator_id:string, name:string, unit:string, topic:string, "
        "metrics:array<struct<dataset_id:string, metric_name:string>>>>"
    ).option("multiLine", True).json(path).select(F.inline("indicators"))
    return rows.drop("metrics"), rows.select("indicator_id", F.inline("metrics"))
