"""Rows of the core tables from features and records; property spellings are tried in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from civicspark.functions import geo, text as tx
from civicspark.operators.state import canonical_json, dedup_key

# fixed values: property spellings
ID_NAMES = ("id", "ID", "objectid")
NAME_NAMES = ("name", "Name", "bezeichnung")
DESCRIPTION_NAMES = ("description", "beschreibung")
VOLATILE_KEYS = ("fme_tstamp",)
OCCUPANCY_NAMES = {
    "total": ("gesamt", "total", "totalparkingcapacity"),
    "occupied": ("belegt", "occupied", "totalnumoccupiedparkingspaces"),
    "free": ("frei", "free", "totalnumvacantparkingspaces"),
    "site_name": ("name", "Name", "parkingfacilityname"),
    "measured": ("timestamp", "measured_at", "phenomenontime"),
}


def _with_props(features: DataFrame) -> DataFrame:
    """Features with a geometry, flat coordinates and the property map."""
    return features.where("geom_type is not null and coords is not null").withColumns({
        "coords": geo.force_2d(F.col("coords")),
        "props": F.coalesce(F.from_json("properties", "map<string,string>"), F.create_map().cast("map<string,string>"))})


def _geometry_text() -> Column:
    return F.concat(F.col("geom_type"), F.to_json("coords"))


def feature_rows(features: DataFrame, dataset_id: str, feature_type: str, year: int | None = None, carry=()) -> DataFrame:
    """Map features with key, name, description and bounding box."""
    named = _with_props(features).withColumn("feature_id", tx.first_present(F.col("props"), ID_NAMES))
    xmin, ymin, xmax, ymax = geo.bbox(F.col("coords"))
    return named.select(
        F.lit(dataset_id).alias("dataset_id"), dedup_key(F.col("feature_id"), F.col("props"), _geometry_text()).alias("dedup_key"),
        "feature_id", F.lit(feature_type).alias("feature_type"), tx.first_present(F.col("props"), NAME_NAMES).alias("name"),
        tx.first_present(F.col("props"), DESCRIPTION_NAMES).alias("description"), "geom_type", "coords",
        xmin.alias("xmin"), ymin.alias("ymin"), xmax.alias("xmax"), ymax.alias("ymax"),
        canonical_json(F.col("props")).alias("properties"), F.lit(year).cast("int").alias("year"), *carry)


def _moment(col: Column) -> Column:
    """Timestamp of ISO text or of the day-first text of the sensor feeds."""
    return F.coalesce(F.try_to_timestamp(col, F.lit("dd.MM.yyyy HH:mm:ss")), col.try_cast("timestamp"))


def restriction_rows(features: DataFrame, dataset_id: str, restriction_type: str, carry=()) -> DataFrame:
    """Traffic restrictions with validity; stamps of the export do not enter the key but are kept."""
    props = F.col("props")
    named = _with_props(features).withColumn("restriction_id", tx.first_present(props, ID_NAMES))
    return named.select(
        F.lit(dataset_id).alias("dataset_id"),
        dedup_key(F.col("restriction_id"), props, _geometry_text(), VOLATILE_KEYS).alias("dedup_key"),
        "restriction_id", F.lit(restriction_type).alias("restriction_type"),
        tx.first_present(props, ("title", "bezeichnung")).alias("title"), tx.first_present(props, DESCRIPTION_NAMES).alias("description"),
        "geom_type", "coords", _moment(tx.first_present(props, ("beginn", "valid_from"))).alias("valid_from"),
        _moment(tx.first_present(props, ("ende", "valid_until"))).alias("valid_until"), canonical_json(props).alias("properties"), *carry)


def occupancy_rows(features: DataFrame) -> DataFrame:
    """Park+Ride readings; a missing number stays missing and zero stays zero."""
    props = F.col("props")
    number = lambda what: tx.parse_int(tx.first_present(props, OCCUPANCY_NAMES[what]))
    rows = _with_props(features).select(
        tx.first_present(props, ("id", "ID")).alias("site_id"), tx.first_present(props, OCCUPANCY_NAMES["site_name"]).alias("site_name"),
        number("total").alias("total"), number("occupied").alias("occupied"), number("free").alias("free"),
        _moment(tx.first_present(props, OCCUPANCY_NAMES["measured"])).alias("measured_at"), "coords")
    return rows.where("site_id is not null").withColumn("occupancy_pct", occupancy(F.col("occupied"), F.col("total")))


def occupancy(occupied: Column, total: Column) -> Column:
    return F.when(total > 0, occupied / total * 100)


def count_rows(records: DataFrame, period: str = "day", carry=()) -> DataFrame:
    """Counter readings; a position needs both coordinates."""
    have = lambda *names: [F.col(f"`{n}`") for n in names if n in records.columns]

    def first(*names: str) -> Column:
        found = [tx.blank_to_null(c.cast("string")) for c in have(*names)]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    lat, lon = tx.parse_number(first("lat", "latitude")), tx.parse_number(first("lon", "longitude"))
    return records.select(
        F.coalesce(first("zaehlstellen_id", "counter_id", "ID"), F.lit("")).alias("counter_id"), first("name", "Name").alias("counter_name"),
        F.lit(period).alias("count_period"), _moment(first("datum", "date", "timestamp")).alias("period_start"),
        tx.parse_int(first("gesamt", "total", "count")).alias("count_value"),
        F.when((lat != 0) & (lon != 0), F.array(F.array(F.array(F.array(lon, lat))))).alias("coords"), *carry)
