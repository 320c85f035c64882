from pyspark.sql import functions as F

from civicspark.operators import reshape as rs


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_period_columns():
    cols = ["Kennziffer", "Merkmal_2", "2003", "1.Qu. 2003", "2001/02", "Jan. 2024", "Hinweis", "Gebiet"]
    assert rs.period_columns(cols) == ["2003", "1.Qu. 2003", "2001/02", "Jan. 2024"]


def test_melt_values_last_row_wins_and_units(spark):
    df = spark.createDataFrame([
        (1, "100", "x", "Beschäftigte", "Männer", "", "Personen", "5", "6"),
        (2, "101", "x", "Beschäftigte", " Männer ", None, "", "7", ""),
        (3, "102", "x", "", "", "", "%", "8", None),
        (4, " ", "x", "", "", "", "%", "9", "9")],
        "n int, Kennziffer string, Merkmal_1 string, Merkmal_2 string, Merkmal_3 string, Merkmal_4 string, Einheit string, `2003` string, `1.Qu. 2004` string")
    assert rows(rs.melt_values(df, "n"), "metric_name", "period") == [
        ("2003", "102", "8", "%"), ("1.Qu. 2004", "Beschäftigte · Männer", "6", "Personen"), ("2003", "Beschäftigte · Männer", "7", "Personen")]


def test_melt_areas(spark):
    df = spark.createDataFrame([(1, " Mitte ", "Einwohner", "1"), (2, "Mitte", "Einwohner", "2"), (3, "", "Einwohner", "3")],
                               "n int, Gebiet string, Sachmerkmal string, `2000` string")
    assert rows(rs.melt_areas(df, "n"), "period") == [("2000", "Mitte", "Einwohner", "2")]


def test_melt_json_drops_suppressed(spark):
    df = spark.createDataFrame([
        (1, "A", "", "", "", "2020", "x", "Euro"), (2, "A", "", "", "", "2021", "5", None), (3, "A", "B", "C", "", "2021", "6", None), (4, "A", "", "", "", "", "7", None)],
        "n int, name string, merkmal_2 string, merkmal_3 string, merkmal_4 string, jahr string, wert string, einheit string")
    assert rows(rs.melt_json_long(df, "n"), "metric_name") == [("2021", "A", "5", "Euro"), ("2021", "B · C", "6", None)]


def test_generic_to_long(spark):
    df = spark.createDataFrame([("1.Qu. 2003", "Mitte", "", "1,5", "abc", "7"), ("n/a", "", "Süd", "2", "3", "7"), ("2004", "", "", None, "4", "7")],
                               "Jahr string, Ortsteil string, Stadtbezirk string, a string, b string, nr string")
    got = rs.generic_to_long(df, F.lit("d"), default_year=1999, skip=["nr"])
    picked = got.select("period_label", "period_year", "period_quarter", "spatial_unit", "spatial_key", "metric_name", "metric_value")
    assert rows(picked, "period_year", "metric_name") == [
        ("1999", 1999, None, "stadtbezirk", "Süd", "a", 2.0), ("1999", 1999, None, "stadtbezirk", "Süd", "b", 3.0),
        ("1.Qu. 2003", 2003, 1, "ortsteil", "Mitte", "a", 1.5), ("2004", 2004, None, "city", "Leipzig", "b", 4.0)]


def test_pinned_key_column(spark):
    df = spark.createDataFrame([("0013", "5")], "`gebiet-nr` string, A string")
    got = rs.generic_to_long(df, F.lit("d"), unit="wahlbezirk", key_column="gebiet-nr").first()
    assert (got["spatial_unit"], got["spatial_key"], got["metric_name"]) == ("wahlbezirk", "0013", "A")


def test_postal_district_is_voting_district():
    assert rs.unit_of_column("Briefwahlbezirk", "city") == "wahlbezirk"


def test_period_month(spark):
    label, year, quarter, month = rs.parse_period(F.col("c"))
    df = spark.createDataFrame([("Jan. 2024",), ("Dez. 1999",), ("Mär. 2001",), ("2001/02",), ("12345",)], "c string")
    got = df.select(label.alias("l"), year.alias("y"), quarter.alias("q"), month.alias("m")).collect()
    assert [tuple(r) for r in got] == [("Jan. 2024", 2024, None, 1), ("Dez. 1999", 1999, None, 12), ("Mär. 2001", 2001, None, 3),
                                       ("2001/02", 2001, None, None), ("", None, None, None)]


def test_election_modes(spark):
    df = spark.createDataFrame([("13", "Mitte", "100", "80", "10", "2", "78", "3", "77", "40", "38", "41", "36"), ("", "", "1", "1", "1", "1", "1", "1", "1", "1", "1", "1", "1")],
                               "`gebiet-nr` string, `gebiet-name` string, A string, B string, B1 string, C string, D string, E string, F string, D1 string, D2 string, F1 string, F2 string")
    got = rs.election_unpivot(df, ["X", "Y"], "erst_zweit", "wahlbezirk").orderBy("party").collect()
    assert [(r["gebiet_code"], r["party"], r["erststimmen"], r["zweitstimmen"]) for r in got] == [("0013", "X", 40, 41), ("0013", "Y", 38, 36)]
    assert (got[0]["ungueltige_erst"], got[0]["gueltige_erst"], got[0]["ungueltige_zweit"], got[0]["gueltige_zweit"]) == (2, 78, 3, 77)
    single = rs.election_unpivot(df, ["X", "Y"], "single", "stadt").first()
    assert (single["gebiet_code"], single["gebiet_name"], single["zweitstimmen"], single["gueltige_zweit"]) == ("leipzig", "Mitte", 40, 78)
    named = rs.election_unpivot(df.withColumn("gebiet-nr", F.lit("")), ["X"], "kommunal", "ortsteil").collect()
    assert [(r["gebiet_code"], r["gueltige_zweit"], r["zweitstimmen"]) for r in named] == [("Mitte", 3, None)]


def test_long_codes_are_not_cut(spark):
    df = spark.createDataFrame([("123456", "N", "1")], "`gebiet-nr` string, `gebiet-name` string, D1 string")
    assert rs.election_unpivot(df, ["X"], "single", "wahlbezirk").first()["gebiet_code"] == "123456"


def test_route_order(spark):
    df = spark.createDataFrame([
        ("a", "", "CSV"), ("b", "u", "PDF"), ("radverkehr", "u", "CSV"), ("radverkehr-gesamt", "u", "GeoJSON"), ("baustellen", "u", "WFS"),
        ("baustellen", "u", "CSV"), ("feed", "u", "GTFS"), ("x", "u", "ZIP"), ("x", "u", "TXT"), ("bäume", "u", "geojson")], "name string, url string, format string")
    got = [(r["target"], r["detail"]) for r in rs.route_target(df, F.lit(False)).collect()]
    assert got == [("skip", "no resource URL"), ("skip", "unsupported format PDF"), ("bicycle_counts", None), ("geo_features", "bicycle_count"),
                   ("traffic_restrictions", "point"), ("statistics", None), ("geo_features", "gtfs_stop"), ("by_content", None), ("summary", None), ("geo_features", "bäume")]
