"""One landed file at a time through the batch ingest."""

import json

import pytest
from pyspark.sql import functions as F

from civicspark import jobs
from civicspark.sources.jsonfiles import read_geojson
from civicspark.operators import loaders


@pytest.fixture(scope="module")
def bounds(spark):
    rows = [("ortsteil", "00", "Zentrum", "0", 0), ("ortsteil", "62", "Grünau-Mitte", "6", 0), ("stadtbezirk", "0", "Mitte", None, 0)]
    return spark.createDataFrame(rows, "boundary_type string, code string, name string, parent_code string, boundary_year int")


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}")


def test_statistics_csv_with_units_and_codes(spark, tmp_path, bounds):
    contract = {"id": "d1", "name": "einwohner", "url": "https://statistik.leipzig.de/opendata/api/values?x", "format": "CSV"}
    head = "Kennziffer,Merkmal_1,Merkmal_2,Merkmal_3,Merkmal_4,Einheit,2003,1.Qu. 2004\n"
    run = jobs.load_dataset(spark, contract, put(tmp_path / "a.csv", head + '1,x,Einwohner,,,Personen,"5,5",x\n'), str(tmp_path / "t"), bounds)
    assert run == {"dataset_id": "d1", "status": "success", "target": "statistics", "rows_loaded": 1, "note": None}
    jobs.load_dataset(spark, contract, put(tmp_path / "b.csv", head + "1,x,Einwohner,,,,6,7\n"), str(tmp_path / "t"), bounds)
    got = sorted((r["period_label"], r["metric_value"], r["metric_unit"]) for r in table(spark, tmp_path / "t", "statistics").collect())
    assert got == [("1.Qu. 2004", 7.0, None), ("2003", 6.0, "Personen")]
    areas = {"id": "d2", "name": "kd", "url": "https://statistik.leipzig.de/opendata/api/kdvalues?x", "format": "CSV"}
    jobs.load_dataset(spark, areas, put(tmp_path / "c.csv", "Gebiet;Sachmerkmal;2000\nZentrum;Einwohner;1\nMitte;Einwohner;2\nGrünau Mitte;Einwohner;3\n"), str(tmp_path / "t"), bounds)
    coded = {r["spatial_key"]: r["spatial_code"] for r in table(spark, tmp_path / "t", "statistics").where("dataset_id = 'd2'").collect()}
    assert coded == {"Zentrum": "00", "Mitte": None, "Grünau Mitte": "62"}


def test_generic_xml(spark, tmp_path):
    contract = {"id": "x", "name": "x", "url": "u", "format": "XML", "family_year": 2019}
    run = jobs.load_dataset(spark, contract, put(tmp_path / "a.xml", "<r><z><a>1</a><t>text</t></z><z><a>2</a></z></r>"), str(tmp_path / "t"))
    assert (run["target"], run["rows_loaded"]) == ("statistics", 2)
    assert {r["period_year"] for r in table(spark, tmp_path / "t", "statistics").collect()} == {2019}


def test_last_row_of_a_key_wins(spark, tmp_path):
    contract = {"id": "x", "name": "x", "url": "u", "format": "CSV"}
    for name, lines in (("a", "A,9\nA,5\nB,1\n"), ("b", "B,7\nB,3\n")):
        run = jobs.load_dataset(spark, contract, put(tmp_path / f"{name}.csv", "ortsteil,wert\n" + lines), str(tmp_path / "t"))
    got = {r["spatial_key"]: r["metric_value"] for r in table(spark, tmp_path / "t", "statistics").collect()}
    assert run["rows_loaded"] == 2 and got == {"A": 5.0, "B": 3.0}


def _features(*items):
    return json.dumps({"type": "FeatureCollection", "features": [
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [12.0 + i / 100, 51.0]}, "properties": p} for i, p in items]})


def test_restrictions_keep_the_stamp_but_not_in_the_key(spark, tmp_path):
    contract = {"id": "r", "name": "Baustellen-polygon", "url": "u", "format": "GeoJSON"}
    folder = str(tmp_path / "t")
    first = _features((1, {"objectid": 42, "title": "A", "beginn": "2024-01-01T00:00:00", "fme_tstamp": "t1"}), (2, {"title": "B", "fme_tstamp": "t1"}), (3, {"title": "C"}))
    second = _features((1, {"objectid": 42, "title": "A2", "fme_tstamp": "t2"}), (2, {"title": "B", "fme_tstamp": "t2"}))
    jobs.load_dataset(spark, contract, put(tmp_path / "a.json", first), folder)
    keys = {r["title"]: r["dedup_key"] for r in table(spark, folder, "traffic_restrictions").collect()}
    jobs.load_dataset(spark, contract, put(tmp_path / "b.json", second), folder)
    rows = {r["title"]: r for r in table(spark, folder, "traffic_restrictions").collect()}
    assert set(rows) == {"A2", "B"}  # C left the snapshot
    assert rows["A2"]["dedup_key"] == "42" and rows["B"]["dedup_key"] == keys["B"]
    assert json.loads(rows["B"]["properties"])["fme_tstamp"] == "t2" and rows["A2"]["restriction_type"] == "polygon"


def test_empty_snapshot_changes_nothing(spark, tmp_path):
    contract = {"id": "g", "name": "bäume", "url": "u", "format": "WFS"}
    folder = str(tmp_path / "t")
    jobs.load_dataset(spark, contract, put(tmp_path / "a.json", _features((1, {"id": "1"}), (2, {"id": "2"}))), folder)
    assert jobs.load_dataset(spark, contract, put(tmp_path / "b.json", _features()), folder)["rows_loaded"] == 0
    assert table(spark, folder, "geo_features").count() == 2
    live = {"id": "p", "name": "P+R", "url": "x/pr_anlage_belegung_lastrecord", "format": "GeoJSON"}
    jobs.load_dataset(spark, live, put(tmp_path / "c.json", _features((1, {"id": "1", "v": 1}), (2, {"id": "2", "v": 1}))), folder)
    jobs.load_dataset(spark, live, put(tmp_path / "d.json", _features((1, {"id": "1", "v": 2}))), folder)
    got = sorted((r["feature_id"], json.loads(r["properties"])["v"], r["feature_type"]) for r in table(spark, folder, "geo_features").where("dataset_id = 'p'").collect())
    assert got == [("1", "2", "park_ride"), ("2", "1", "park_ride")]  # no sweep for the live feed


def test_elections(spark, tmp_path, bounds):
    contract = {"id": "e", "name": "wahl", "url": "u", "format": "CSV"}
    election = {"election_id": "ew", "vote_mode": "single", "parties": ["X", "Y"], "level": "ortsteil"}
    path = put(tmp_path / "e.csv", "gebiet-nr;gebiet-name;A;B;C;D;D1;D2\n;Zentrum;100;80;2;78;40;38\n")
    assert jobs.load_dataset(spark, contract, path, str(tmp_path / "t"), bounds, election)["rows_loaded"] == 2
    row = table(spark, tmp_path / "t", "election_results").where("party = 'X'").first()
    assert (row["gebiet_code"], row["spatial_code"], row["zweitstimmen"], row["gueltige_zweit"]) == ("Zentrum", "00", 40, 78)


def test_skips_and_summary(spark, tmp_path):
    assert jobs.load_dataset(spark, {"id": "a", "name": "", "url": "", "format": "CSV"}, "", "")["note"] == "no resource URL"
    assert jobs.load_dataset(spark, {"id": "a", "name": "", "url": "u", "format": "pdf"}, "", "")["status"] == "skipped"
    assert jobs.load_dataset(spark, {"id": "a", "name": "", "url": "u", "format": "TXT"}, "", "")["note"].startswith("DQ")


def test_counts(spark, tmp_path):
    contract = {"id": "c", "name": "Radverkehr", "url": "u", "format": "CSV"}
    path = put(tmp_path / "c.csv", "zaehlstellen_id,datum,gesamt,lat,lon\nA,2024-01-01,5,51.3,12.4\nA,2024-01-02,x,0,12.4\n")
    jobs.load_dataset(spark, contract, path, str(tmp_path / "t"))
    got = sorted((r["period_start"].day, r["count_value"], r["coords"]) for r in table(spark, tmp_path / "t", "bicycle_counts").collect())
    assert got == [(1, 5, [[[[12.4, 51.3]]]]), (2, None, None)]


def test_occupancy_of_the_captured_feed_names(spark, tmp_path):
    text = _features((1, {"id": "s", "parkingfacilityname": "Knauthain", "totalparkingcapacity": 30, "totalnumoccupiedparkingspaces": 0,
                          "totalnumvacantparkingspaces": 30, "phenomenontime": "09.03.2026 04:20:00"}), (2, {"x": 1}))
    row = loaders.occupancy_rows(read_geojson(spark, put(tmp_path / "a.json", text))).collect()
    assert len(row) == 1 and (row[0]["total"], row[0]["occupied"], row[0]["free"], row[0]["occupancy_pct"]) == (30, 0, 30, 0.0)
    assert str(row[0]["measured_at"]) == "2026-03-09 04:20:00"


def test_table_layout_round_trip(spark, tmp_path):
    from civicspark.sources.tables import read_table, write_table

    df = spark.range(1000).select(F.when(F.col("id") < 400, "hot").otherwise(F.concat(F.lit("d"), (F.col("id") % 5).cast("string"))).alias("dataset_id"),
                                  F.lit("city").alias("spatial_unit"), (F.col("id") % 7).cast("string").alias("metric_name"), (F.col("id") % 30).cast("int").alias("period_year"))
    write_table(df, str(tmp_path), "statistics")
    back = read_table(spark, str(tmp_path), "statistics")
    assert back.count() == 1000 and back.where("dataset_id = 'hot'").count() == 400


def test_runs_feed_the_change_log(spark, tmp_path):
    import datetime as dt

    from civicspark.operators import state as st

    contract = {"id": "g", "name": "bäume", "url": "u", "format": "WFS"}
    folder = str(tmp_path / "t")
    snapshots = [(1, 2), (1, 2, 3), (3,)]
    for i, ids in enumerate(snapshots):
        path = put(tmp_path / f"{i}.json", _features(*[(k, {"id": str(k)}) for k in ids]))
        run = jobs.load_dataset(spark, contract, path, folder)
        at = dt.datetime(2024, 1, 1 + i, 2)
        jobs.record_run(spark, folder, run, f"r{i}", at, at + dt.timedelta(seconds=5))
    skipped = jobs.load_dataset(spark, {"id": "a", "name": "", "url": "", "format": "CSV"}, "", folder)
    jobs.record_run(spark, folder, skipped, "r9", at, at)
    runs = spark.read.parquet(f"{folder}/runs")
    assert runs.count() == 4 and set(r["duration_s"] for r in st.run_log(runs).collect()) == {0, 5}
    log = st.change_log(runs.where("target is not null"), ["dataset_id", "target"], ["started_at", "run_id"], "day")
    got = [(r["run_id"], r["rows_added"], r["rows_updated"], r["rows_total_after"]) for r in log.orderBy("run_id").collect()]
    assert got == [("r0", 2, 0, 2), ("r1", 1, 2, 3), ("r2", 0, 1, 1)]
