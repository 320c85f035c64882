import io
import json
import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from civicspark.functions import geo
from civicspark.operators import tiles as tl
from civicspark.sources import archives, delimited, jsonfiles


def put(path, data):
    path.write_bytes(data if isinstance(data, bytes) else data.encode("utf-8"))
    return str(path)


@pytest.mark.parametrize("header, want", [("a;b,c;d", ";"), ("a,b", ","), ("a\tb\tc", "\t"), ("a|b", "|"), ("plain", ",")])
def test_sniff(header, want):
    assert delimited.sniff_separator(header) == want


def test_delimited_utf8_mark_quotes_and_newlines(spark, tmp_path):
    path = put(tmp_path / "a.csv", '﻿ Name ;Wert\n"Mitte; ""Süd""\nOst"; 1,5 \nLeer;\nNul\x00l;2\n')
    df = delimited.read_delimited(spark, path)
    assert df.columns == ["Name", "Wert"]
    assert [tuple(r) for r in df.collect()] == [('Mitte; "Süd"\nOst', "1,5"), ("Leer", None), ("Null", "2")]


def test_delimited_latin1(spark, tmp_path):
    path = put(tmp_path / "b.csv", "Straße,Größe\nMüller,1\n".encode("latin-1"))
    assert [tuple(r) for r in delimited.read_delimited(spark, path).collect()] == [("Müller", "1")]


def test_folder_of_unlike_files(spark, tmp_path):
    put(tmp_path / "a.csv", "name;wert\nMüller;1\n")
    put(tmp_path / "b b.csv", "name,wert,neu\nGröße,2,x\n".encode("latin-1"))
    put(tmp_path / "c.csv", "name;wert\nWeiß;3\n")
    got = sorted(tuple(r) for r in delimited.read_delimited(spark, str(tmp_path)).select("name", "wert", "neu").collect())
    assert got == [("Größe", "2", "x"), ("Müller", "1", None), ("Weiß", "3", None)]


@pytest.mark.parametrize("doc", [[{"a": 1, "b": "x"}], {"values": [{"a": 1, "b": "x"}]}, {"total": 1, "data": [{"a": 1, "b": "x"}]}, {"a": 1, "b": "x"}])
def test_json_envelopes(spark, tmp_path, doc):
    df = jsonfiles.read_records(spark, put(tmp_path / "a.json", json.dumps(doc)))
    assert [(r["a"], r["b"]) for r in df.collect()] == [("1", "x")]


def _collection(crs, *coords):
    feats = [{"type": "Feature", "id": f"f{i}", "geometry": {"type": "Point", "coordinates": c}, "properties": {"objectid": i, "n": {"x": 1}}} for i, c in enumerate(coords)]
    return {"type": "FeatureCollection", **({"crs": {"type": "name", "properties": {"name": crs}}} if crs else {}), "features": feats}


@pytest.mark.parametrize("crs, point, lon, lat", [
    ("EPSG:4326", [12.30932298, 51.27711607], 12.30932298, 51.27711607), (None, [12.30932298, 51.27711607, 9.0], 12.30932298, 51.27711607),
    ("urn:ogc:def:crs:EPSG::25833", [316626.384556, 5690467.490877], 12.367455, 51.335880)])
def test_geojson_reprojection(spark, tmp_path, crs, point, lon, lat):
    row = jsonfiles.read_geojson(spark, put(tmp_path / "a.geojson", json.dumps(_collection(crs, point)))).first()
    x, y = row["coords"][0][0][0][:2]
    assert (x, y) == (pytest.approx(lon, abs=1e-6), pytest.approx(lat, abs=1e-6))
    assert 12.0 < x < 12.7 and 51.2 < y < 51.5 and json.loads(row["properties"])["objectid"] == 0


def test_geojson_bare_array_and_round_trip(spark, tmp_path):
    polygon = {"type": "Polygon", "coordinates": [[[12.0, 51.0], [12.1, 51.0], [12.1, 51.1], [12.0, 51.0]]]}
    feats = [{"type": "Feature", "geometry": polygon, "properties": {"n": "a"}}, {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[12.0, 51.0], [12.2, 51.2]]}, "properties": None}]
    df = jsonfiles.read_geojson(spark, put(tmp_path / "a.json", json.dumps(feats)))
    assert sorted(r["geom_type"] for r in df.collect()) == ["LineString", "Polygon"]
    out = str(tmp_path / "out")
    jsonfiles.write_geojson(df.withColumn("name", F.lit("x")), out, ["name"])
    back = jsonfiles.read_geojson(spark, out, lines=True)
    assert sorted(map(str, (r["coords"] for r in back.collect()))) == sorted(map(str, (r["coords"] for r in df.collect())))
    line = json.loads(spark.read.text(out).where(F.col("value").contains("Polygon")).first()["value"])
    assert line["geometry"] == polygon and line["properties"] == {"name": "x"}


def _zip(**members):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return buf.getvalue()


def test_gtfs(spark, tmp_path):
    stops = "﻿stop_id,stop_name,stop_lat,stop_lon,zone\n1,Markt,51.3,12.4,a\n2,Null,0,12.4,a\n3,Kaputt,abc,12.4,a\n4,Leer,,12.4,a\n"
    put(tmp_path / "g.zip", _zip(feed__stops_dot_txt=stops, feed__routes_dot_txt="route_id,name\nR1,x\nR2,y\n"))
    put(tmp_path / "empty.zip", _zip(readme_dot_md="x"))
    files = archives.read_binary(spark, str(tmp_path))
    got = archives.gtfs_stops(files).collect()
    assert [(r["feature_id"], r["name"], r["coords"]) for r in got] == [("1", "Markt", [[[[12.4, 51.3]]]])]
    assert json.loads(got[0]["properties"])["zone"] == "a"
    assert sorted(r["route_id"] for r in archives.gtfs_routes(files).collect()) == ["R1", "R2"]


def test_zip_kinds(spark, tmp_path):
    put(tmp_path / "a.zip", _zip(b_dot_csv="x;y\n1;ü\n", sub__a_dot_geojson="{}"))
    put(tmp_path / "b.zip", _zip(a_dot_GeoJSON=json.dumps(_collection(None, [1.0, 2.0])), b_dot_csv="x\n1\n"))
    put(tmp_path / "c.zip", _zip(a_dot_shp="x", b_dot_csv="x\n1\n"))
    put(tmp_path / "d.zip", _zip(a_dot_txt="x"))
    rows = archives.zip_rows(archives.read_binary(spark, str(tmp_path))).collect()
    kinds = {r["path"].rpartition("/")[2]: r["kind"] for r in rows}
    assert kinds == {"a.zip": "CSV", "b.zip": "GeoJSON", "c.zip": "SHP", "d.zip": "unknown"}
    payloads = sorted(r["payload"] for r in rows if r["payload"])
    assert json.loads(payloads[1]) == {"x": "1", "y": "ü"} and json.loads(payloads[0])["type"] == "Feature"


@pytest.mark.parametrize("doc, want", [
    ('<r xmlns="urn:x"><z id="1"><n> A </n><o><p>2</p></o></z><z id="2"><n/></z></r>', [{"id": "1", "n": "A", "o_p": "2"}, {"id": "2", "n": ""}]),
    ("<r><a>1</a><b>2</b></r>", [{"a": "1", "b": "2"}]), ("<r>text</r>", [{"value": "text"}]), ("<r><broken></r>", [])])
def test_xml_shapes(spark, tmp_path, doc, want):
    rows = archives.xml_records(archives.read_binary(spark, put(tmp_path / "a.xml", doc))).collect()
    assert [json.loads(r["record"]) for r in rows] == want


def test_xml_rows_reader(spark, tmp_path):
    path = put(tmp_path / "a.xml", '<r><z id="01"><n>A</n><o><p>2</p></o></z><z id="02"><n>B</n></z></r>')
    got = sorted((r["id"], r["n"], r["o_p"]) for r in archives.read_xml_rows(spark, path, "z").collect())
    assert got == [("01", "A", "2"), ("02", "B", None)]


def test_registries(spark, tmp_path):
    fam = {"families": [{"family_id": "f", "title": "F", "members": [{"dataset_id": "a", "year": 2020, "title": "F 2020"}]}],
           "dataset_hints": {"a": {"spatial_unit": "ortsteil", "spatial_key_column": "gebiet-nr", "skip_columns": ["x"]}}}
    members, hints = jsonfiles.read_families(spark, put(tmp_path / "f.json", json.dumps(fam, indent=1)))
    assert [(r["family_id"], r["dataset_id"], r["family_year"]) for r in members.collect()] == [("f", "a", 2020)]
    assert [(r["dataset_id"], r["spatial_key_column"], r["skip_columns"], r["year"]) for r in hints.collect()] == [("a", "gebiet-nr", ["x"], None)]
    el = {"elections": [{"election_id": "e", "title": "E", "election_type": "t", "date": "2021-09-26", "year": 2021, "vote_mode": "single", "parties": ["B", "A"],
                         "datasets": {"d1": {"level": "stadt"}, "d2": {"level": "ortsteil"}}}], "kleinraeumig_sources": {"k": "t"}}
    elections, routes, sources = jsonfiles.read_elections(spark, put(tmp_path / "e.json", json.dumps(el)))
    assert elections.first()["parties"] == ["B", "A"] and sources.first()["election_type"] == "t"
    assert sorted((r["dataset_id"], r["level"]) for r in routes.collect()) == [("d1", "stadt"), ("d2", "ortsteil")]
    parties = {"parties": [{"key": "p", "name": "P", "position": None, "color": "#1", "aliases": ["PP"]}]}
    assert jsonfiles.read_parties(spark, put(tmp_path / "p.json", json.dumps(parties))).first()["position"] is None


def _tile(lon, lat, z):
    n = 2**z
    y = (1 - math.log(math.tan(math.radians(lat)) + 1 / math.cos(math.radians(lat))) / math.pi) / 2 * n
    return int((lon + 180) / 360 * n), int(y)


def test_tiles(spark):
    pts = [("d", str(i), "Point", [[[[12.37 + i * 1e-4, 51.33]]]], 2020) for i in range(50)]
    feats = tl.with_bbox(spark.createDataFrame(pts, "dataset_id string, feature_id string, geom_type string, coords array<array<array<array<double>>>>, year int"))
    got = tl.detail_tiles(feats, [16]).collect()
    home = {r["feature_id"]: set() for r in got}
    for r in got:
        home[r["feature_id"]].add((r["x"], r["y"]))
    assert len(home) == 50
    for _, fid, _, coords, _ in pts:
        assert _tile(*coords[0][0][0], 16) in home[fid]
    capped = tl.detail_tiles(feats, [14], cap=7).groupBy("z", "x", "y").count().collect()
    assert max(r["count"] for r in capped) == 7
    clusters = tl.cluster_tiles(feats, [10]).collect()
    assert sum(r["point_count"] for r in clusters) >= 50 and len(clusters) < 10
    with pytest.raises(ValueError):
        tl.detail_tiles(feats, [13])
    tagged = feats.withColumn("family_id", F.when(F.col("feature_id") < "2", "fam"))
    assert tl.chosen_layers(tagged, ["x"], ["fam"]).count() == tl.chosen_layers(tagged, None, ["fam"]).count() == 12
    assert tl.chosen_layers(tagged, ["d"], None).count() == 50


def test_simplify(spark):
    zigzag = [[i / 100, (i % 2) * 1e-4] for i in range(101)]
    ring = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.5, 1.0 + 1e-5], [0.0, 1.0], [0.0, 0.0]]
    df = spark.createDataFrame([("l", [[zigzag]]), ("p", [[ring]]), ("t", [[[[0.0, 0.0], [1e-9, 0.0], [0.0, 1e-9], [0.0, 0.0]]]]), ("n", None)],
                               "k string, coords array<array<array<array<double>>>>")
    got = {r["k"]: r["c"] for r in df.select("k", tl.simplify(F.col("coords"), F.lit(1e-3)).alias("c")).collect()}
    assert len(got["l"][0][0]) == 2 and got["p"][0][0] == [p for p in ring if p[0] != 0.5] and len(got["t"][0][0]) == 4 and got["n"] is None


def _one_ring(ring, tolerance):
    """The recursive form, for comparison."""
    def far(a, b):
        (ax, ay), (bx, by) = ring[a][:2], ring[b][:2]
        best, at = -1.0, None
        for i in range(a + 1, b):
            px, py = ring[i][:2]
            span = math.hypot(bx - ax, by - ay)
            away = math.hypot(px - ax, py - ay) if span == 0 else abs((px - ax) * (by - ay) - (py - ay) * (bx - ax)) / span
            if away > best:
                best, at = away, i
        return best, at

    def walk(a, b):
        away, at = far(a, b)
        return [] if at is None or away <= tolerance else [*walk(a, at), at, *walk(at, b)]

    if not ring:
        return []
    kept = sorted({0, len(ring) - 1, *walk(0, len(ring) - 1)})
    if len(ring) >= 4 and ring[0][:2] == ring[-1][:2] and len(kept) < 4:
        kept = range(len(ring))
    return [list(ring[i][:2]) for i in kept]


def test_simplify_keeps_the_same_points(spark):
    rnd = random.Random(4)

    def ring():
        n = rnd.choice([0, 1, 2, 3, 5, 40, 300])
        line = [[rnd.randint(0, 60) / 7.0, rnd.randint(0, 60) / 7.0] + [1.0] * rnd.randint(0, 1) for _ in range(n)]
        return line + [line[0][:2]] if n and rnd.random() < 0.5 else line

    shapes = [(k, [[ring() for _ in range(rnd.randint(0, 3))] for _ in range(rnd.randint(0, 3))], rnd.choice([0.0, 0.3, 2.0, 50.0])) for k in range(120)]
    df = spark.createDataFrame(shapes, "k int, coords array<array<array<array<double>>>>, tol double").repartition(3)
    got = {r["k"]: r["c"] for r in df.select("k", tl.simplify(F.col("coords"), F.col("tol")).alias("c")).collect()}
    for k, shape, tol in shapes:
        assert got[k] == [[_one_ring(r, tol) for r in poly] for poly in shape], k


def test_cover_is_the_box(spark):
    rnd = random.Random(9)
    boxes = [(str(i), x, y, x + w, y + h) for i in range(40) for x, y, w, h in [
        (rnd.uniform(-179, 170), rnd.uniform(-80, 70), rnd.choice([0.0, 0.4, 3.0, 9.0]), rnd.choice([0.0, 0.4, 3.0, 9.0]))]]
    df = spark.createDataFrame([("world", -180.0, -85.0, 180.0, 85.0), *boxes], "feature_id string, xmin double, ymin double, xmax double, ymax double")
    tiles = {(r.feature_id, r.z, r.x, r.y) for r in tl.assign_tiles(df, [0, 5, 9]).collect()}
    cover = tl.cover_tiles(df, [0, 5, 9])
    spread = [(r.feature_id, r.z, (r.cell_x << k) + i, (r.cell_y << k) + j) for r in cover.collect() for k in [r.z - r.cell_z]
              for i in range(1 << k) for j in range(1 << k)]
    assert len(spread) == len(set(spread)) and set(spread) == tiles
    asked = spark.createDataFrame(sorted({(z, x, y) for _, z, x, y in rnd.sample(sorted(tiles), 300)}), "z int, x int, y int")
    wanted = {tuple(r) for r in asked.collect()}
    found = [(r.feature_id, r.z, r.x, r.y) for r in tl.features_of(cover, asked).collect()]
    assert sorted(found) == sorted(t for t in tiles if t[1:] in wanted)


def test_cover_of_a_large_area_is_short(spark):
    big = spark.createDataFrame([("a", 5.0, 40.0, 28.0, 52.0)], "feature_id string, xmin double, ymin double, xmax double, ymax double")
    box = tl._boxed(big, [16]).first()
    wide, high = box._x1 - box._x0 + 1, box._y1 - box._y0 + 1
    assert wide * high > 10_000_000
    assert tl.cover_tiles(big, [16]).count() <= 4 * (wide + high)


def test_tiles_above_the_old_limit(spark):
    many = tl.with_bbox(spark.range(20_500).select(
        F.lit("d").alias("dataset_id"), F.col("id").cast("string").alias("feature_id"), F.lit("Point").alias("geom_type"),
        F.array(F.array(F.array(F.array(F.lit(12.3701), F.lit(51.3301))))).alias("coords"), F.lit(2020).alias("year")))
    assert tl.detail_tiles(many, [14]).groupBy("z", "x", "y").count().first()["count"] == 20_500


def test_force_2d_and_multi(spark):
    df = spark.createDataFrame([("Point", [[[[1.0, 2.0, 3.0]]]]), ("MultiPolygon", [[[[1.0, 2.0]]]])], "t string, c array<array<array<array<double>>>>")
    got = [tuple(r) for r in df.select(geo.multi_type(F.col("t")), geo.force_2d(F.col("c"))).collect()]
    assert got == [("MultiPoint", [[[[1.0, 2.0]]]]), ("MultiPolygon", [[[[1.0, 2.0]]]])]
