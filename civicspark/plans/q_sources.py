"""Source and sink round trips: given tables are written in each format and read back."""

from __future__ import annotations

import io
import json
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from civicspark.operators import tiles as tl
from civicspark.plans import roles
from civicspark.plans.registry import Tables, query
from civicspark.plans.roles import ctes
from civicspark.session import work_path
from civicspark.sources import archives, delimited, jsonfiles

SUPPLIER_TEXT = "SELECT CAST(s_suppkey AS VARCHAR) id, s_name AS name, replace(CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS VARCHAR), '.', ',') betrag FROM supplier"


def _supplier_text(t: Tables):
    money = F.replace(F.col("s_acctbal").cast(roles.MONEY).cast("string"), F.lit("."), F.lit(","))
    return t.supplier.select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), money.alias("betrag"))


@query("src_csv_sniff", "SELECT doc_id, md5(text) digest, lang FROM (SELECT CAST(doc_id AS VARCHAR) doc_id, trim(replace(replace(text, chr(0), ''), chr(13), ' '), ' ') AS text, lang FROM documents)")
def src_csv_sniff(t: Tables):
    # whole texts with quotes and line breaks survive the round trip
    path = work_path(t.spark, "csv")
    docs = t.documents.select(F.col("doc_id").alias(" doc_id "), F.trim(F.translate(F.replace("text", F.lit("\r"), F.lit(" ")), "\u0000", "")).alias("text"), "lang")
    delimited.write_delimited(docs, path, ";")
    return delimited.read_delimited(t.spark, path).select("doc_id", F.md5("text").alias("digest"), "lang")


@query("sink_csv", SUPPLIER_TEXT)
def sink_csv(t: Tables):
    path = work_path(t.spark, "csv")
    delimited.write_delimited(_supplier_text(t), path)
    return delimited.read_delimited(t.spark, path, ",", "UTF-8", multi_line=False)


def _documents(df, wrap):
    """One JSON document per Arrow batch, built inside the tasks."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"value": [wrap(pdf.to_dict("records"))]})

    return df.mapInPandas(run, "value string")


@query("src_json_envelope", SUPPLIER_TEXT)
def src_json_envelope(t: Tables):
    path = work_path(t.spark, "json")
    _documents(_supplier_text(t), lambda rows: json.dumps({"total": len(rows), "values": rows})).write.text(path)
    return jsonfiles.read_records(t.spark, path, lines=True).select("id", "name", "betrag")


@query("src_geojson", ctes("features") + "SELECT name, geom_type, vertices, round(xmin, 6) xmin, round(ymin, 6) ymin, round(xmax, 6) xmax, round(ymax, 6) ymax, 4326 epsg FROM features")
def src_geojson(t: Tables):
    path = work_path(t.spark, "geojson")
    jsonfiles.write_geojson(roles.features(t), path, ["feature_id", "name", "year"])
    back = tl.with_bbox(jsonfiles.read_geojson(t.spark, path, lines=True))
    return back.select(
        F.get_json_object("properties", "$.name").alias("name"), "geom_type", F.size(F.flatten(F.flatten("coords"))).alias("vertices"),
        *[F.round(c, 6).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")], "epsg")


def _whole_documents(path: str, df, head: str, tail: str) -> None:
    """One document per task, written row by row: ``head``, the JSON texts of ``df`` as elements of a list, ``tail``."""

    def run(batches):
        opening = head
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"value": [opening + pdf["value"].iloc[0], *("," + v for v in pdf["value"].iloc[1:])]})
                opening = ","
        yield pd.DataFrame({"value": [tail if opening == "," else head + tail]})

    df.select("value").mapInPandas(run, "value string").write.text(path)


@query("src_geojson_collection", ctes("features") + "SELECT name, geom_type, vertices, round(xmin, 6) xmin, round(ymin, 6) ymin, round(xmax, 6) xmax, round(ymax, 6) ymax, 4326 epsg FROM features")
def src_geojson_collection(t: Tables):
    # large collections, cut into features by many tasks
    path = work_path(t.spark, "collections")
    rows = roles.features(t).select(jsonfiles.feature_json(["feature_id", "name", "year"]).alias("value"))
    _whole_documents(path, rows, '{"type":"FeatureCollection","crs":{"type":"name","properties":{"name":"EPSG:4326"}},"features":[', "]}")
    back = tl.with_bbox(jsonfiles.read_geojson(t.spark, path))
    return back.select(
        F.get_json_object("properties", "$.name").alias("name"), "geom_type", F.size(F.flatten(F.flatten("coords"))).alias("vertices"),
        *[F.round(c, 6).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")], "epsg")


@query("src_json_collection", "SELECT CAST(doc_id AS VARCHAR) doc_id, md5(text) digest, lang FROM documents")
def src_json_collection(t: Tables):
    # whole texts, with all their brackets and quotes, as records of large envelopes
    path = work_path(t.spark, "envelopes")
    rows = t.documents.select(F.to_json(F.struct("doc_id", "text", "lang"), {"ignoreNullFields": "false"}).alias("value"))
    _whole_documents(path, rows, '{"help":{"values":"x"},"values":[', ']}')
    return jsonfiles.read_records(t.spark, path).select("doc_id", F.md5("text").alias("digest"), "lang")


@query("sink_geojson", ctes("features") + "SELECT 'Feature' AS \"type\", geom_type, name, CAST(year AS VARCHAR) AS year FROM features")
def sink_geojson(t: Tables):
    path = work_path(t.spark, "geojson")
    jsonfiles.write_geojson(roles.features(t), path, ["name", "year"])
    lines = t.spark.read.text(path)
    pick = lambda p, n: F.get_json_object("value", p).alias(n)
    return lines.select(pick("$.type", "type"), pick("$.geometry.type", "geom_type"), pick("$.properties.name", "name"), pick("$.properties.year", "year"))


def _zipped(df, members):
    """(path, content): one archive per Arrow batch; ``members`` maps a frame to file texts."""

    def run(batches):
        for i, pdf in enumerate(batches):
            buf = io.BytesIO()
            with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
                for name, text in members(pdf).items():
                    z.writestr(name, text)
            yield pd.DataFrame({"path": [f"batch-{i}.zip"], "content": [buf.getvalue()]})

    return df.mapInPandas(run, "path string, content binary")


def _gtfs(t: Tables):
    key = F.col("c_custkey")
    bad = F.when(F.col("c_mktsegment") == "BUILDING", "0").when(F.col("c_mktsegment") == "MACHINERY", "n/a")
    lat = (51.2 + (key * 91 % 300) / 1000).cast("decimal(9,3)").cast("string")
    lon = (12.0 + (key * 37 % 700) / 1000).cast("decimal(9,3)").cast("string")
    stops = t.customer.select(key.cast("string").alias("stop_id"), F.col("c_name").alias("stop_name"), F.coalesce(bad, lat).alias("stop_lat"), lon.alias("stop_lon"))
    return _zipped(stops, lambda pdf: {
        "feed/stops.txt": "﻿" + pdf.to_csv(index=False),
        "feed/routes.txt": pdf[["stop_id"]].rename(columns={"stop_id": "route_id"}).to_csv(index=False)})


@query("src_gtfs_stops", """
SELECT CAST(c_custkey AS VARCHAR) feature_id, c_name AS name, round(12.0 + (c_custkey * 37 % 700) / 1000.0, 3) lon, round(51.2 + (c_custkey * 91 % 300) / 1000.0, 3) lat
FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')
""")
def src_gtfs_stops(t: Tables):
    stops = archives.gtfs_stops(_gtfs(t))
    return stops.select("feature_id", "name", F.col("coords")[0][0][0][0].alias("lon"), F.col("coords")[0][0][0][1].alias("lat"))


@query("src_gtfs_routes", "SELECT CAST(c_custkey AS VARCHAR) route_id FROM customer")
def src_gtfs_routes(t: Tables):
    return archives.gtfs_routes(_gtfs(t)).select("route_id")


@query("src_zip_route", SUPPLIER_TEXT.replace("SELECT ", "SELECT 'CSV' kind, ", 1))
def src_zip_route(t: Tables):
    zipped = _zipped(_supplier_text(t), lambda pdf: {"readme.txt": "x", "data/werte.csv": pdf.to_csv(index=False, sep=";")})
    rows = archives.zip_rows(zipped).where("payload is not null")
    return rows.select("kind", F.from_json("payload", "id string, name string, betrag string").alias("r")).select("kind", "r.*")


@query("src_xml_rows", "SELECT CAST(s_suppkey AS VARCHAR) id, s_name AS name, CAST(s_nationkey AS VARCHAR) ort_nation FROM supplier")
def src_xml_rows(t: Tables):
    path = work_path(t.spark, "xml")
    rows = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.struct(F.col("s_nationkey").alias("nation")).alias("ort"))
    rows.write.format("xml").option("rootTag", "zeilen").option("rowTag", "zeile").save(path)
    return archives.read_xml_rows(t.spark, path, "zeile").select("id", "name", "ort_nation")


@query("src_xml_records", "SELECT CAST(s_suppkey AS VARCHAR) id, s_name AS name, CAST(s_nationkey AS VARCHAR) ort_nation FROM supplier")
def src_xml_records(t: Tables):
    def wrap(rows):
        items = "".join(f'<z:zeile id="{r["id"]}"><name>{r["name"]}</name><ort><nation>{r["nation"]}</nation></ort></z:zeile>' for r in rows)
        return f'<z:zeilen xmlns:z="urn:z">{items}</z:zeilen>'

    rows = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    files = _documents(rows, wrap).select(F.lit("mem").alias("path"), F.col("value").cast("binary").alias("content"))
    return archives.xml_records(files).select(F.from_json("record", "id string, name string, ort_nation string").alias("r")).select("r.*")


@query("registry_explode", ctes("registry") + """
SELECT family_id, dataset_id, family_year, title, CASE WHEN schedule = 'live' THEN 'gebiet-nr' END hint_key_column FROM registry WHERE family_id IS NOT NULL
""")
def registry_explode(t: Tables):
    path = work_path(t.spark, "families")
    reg = roles.registry(t).where("family_id is not null")
    member = F.struct("dataset_id", F.col("family_year").alias("year"), "title")
    hint = F.struct(F.lit("ortsteil").alias("spatial_unit"), F.lit("gebiet-nr").alias("spatial_key_column"))
    # one document per family; a family holds the year variants of one title block
    docs = reg.groupBy("family_id").agg(
        F.collect_list(member).alias("members"),
        F.map_from_entries(F.collect_list(F.when(F.col("schedule") == "live", F.struct("dataset_id", hint.alias("h"))))).alias("dataset_hints"))
    lines = docs.select(F.to_json(F.struct(F.array(F.struct("family_id", "members")).alias("families"), "dataset_hints")).alias("value"))
    lines.write.text(path)
    members, hints = jsonfiles.read_families(t.spark, path, lines=True)
    return members.join(hints, "dataset_id", "left").select(
        "family_id", "dataset_id", "family_year", "title", F.col("spatial_key_column").alias("hint_key_column"))
