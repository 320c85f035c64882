import pytest

from civicspark.operators import catalog as ct


def test_families(spark):
    df = spark.createDataFrame([
        ("1", "Vornamensstatistik 2021"), ("2", "Vornamenstatistik 2022"), ("3", "Vornamenstatistik"), ("4", "Bäume"), ("5", "Bäume"), ("6", "Wahl 2020"),
        ("7", "Schüler 2001/02 (kurz)"), ("8", "Schüler 2002/03 (kurz)")], "dataset_id string, title string")
    got = sorted((r["family_id"], r["dataset_id"], r["year"], r["needs_review"]) for r in ct.detect_families(df).collect())
    assert got == [("schueler-kurz", "7", 2001, False), ("schueler-kurz", "8", 2002, False), ("vornamenstatistik", "1", 2021, False),
                   ("vornamenstatistik", "2", 2022, False), ("vornamenstatistik", "3", None, True)]
    titles = {r["family_title"] for r in ct.detect_families(df).where("family_id = 'vornamenstatistik'").collect()}
    assert titles == {"Vornamenstatistik"}


def test_category_steps(spark):
    data = spark.createDataFrame([("a", ""), ("b", ""), ("c", "https://statistik.leipzig.de/x?kategorie_nr=15&y"), ("d", "https://statistik.leipzig.de/x?kategorie_nr=99"),
                                  ("e", "https://other/?kategorie_nr=1")], "dataset_id string, url string")
    groups = spark.createDataFrame([("a", "verkehr"), ("a", "umwelt"), ("z", "umwelt")], "dataset_id string, category_id string")
    fam = spark.createDataFrame([("f", "a"), ("f", "b"), ("g", "e")], "family_id string, dataset_id string")
    got = sorted((r["dataset_id"], r["category_id"], r["source"]) for r in ct.assign_categories(data, groups, fam).collect())
    assert got == [
        ("a", "umwelt", "group"), ("a", "verkehr", "group"), ("b", "umwelt", "family"), ("b", "verkehr", "family"),
        ("c", "bevoelkerung-und-gesellschaft", "kategorie_nr"), ("c", "regierung-und-oeffentlicher-sektor", "kategorie_nr"),
        ("d", "sonstiges", "fallback"), ("e", "sonstiges", "fallback")]


def test_capabilities_count_marks_of_statistics(spark, capsys):
    stats = spark.createDataFrame([
        ("1", "city", None, "m", 2020), ("1", "city", None, "m", 2021), ("1", "city", "9", "k", 2021), ("1", "city", None, None, None),
        ("1", "ortsteil", "01", "m", 2022), ("1", "ortsteil", "01", "m", 2022), ("1", "wahlbezirk", "02", None, 2023), ("1", "stadtbezirk", None, "x", 2024),
        ("1", "nation", "1", "x", 2024), ("2", "city", None, "m", None), (None, "city", None, "m", 2020), ("3", "ortsteil", "01", "y2020", 2020)],
        "dataset_id string, spatial_unit string, spatial_code string, metric_name string, period_year int")
    registry = spark.createDataFrame([(d, True, ["t"]) for d in "1234"], "dataset_id string, is_active boolean, categories array<string>")
    features = spark.createDataFrame([], "dataset_id string, geom_type string, feature_type string, year int")
    themes = spark.createDataFrame([("t", 1)], "category_id string, position int")
    caps = ct.capabilities(registry, features, stats, spark.createDataFrame([], "dataset_id string"), themes)
    got = {r["dataset_id"]: tuple(r)[1:] for r in caps.select(
        "dataset_id", "ort_n", "ort_metrics", "city_n", "city_metrics", "city_years").collect()}
    assert got == {"1": (3, 1, 4, 2, 2), "2": (0, 0, 1, 1, 0), "3": (1, 1, 0, 0, 0), "4": (0, 0, 0, 0, 0)}
    # no row is copied once per distinct count
    caps.explain()
    assert "Expand" not in capsys.readouterr().out


def test_indicator_folding(spark):
    rows = [("1", "Arbeitslose (kleinräumig)", "Arbeit", "Frauen", None, 1), ("2", "Einwohner", "Demografie", "Frauen", "Personen", 2),
            ("3", "Löhne", "Arbeit", "Lohn in Euro", None, 3), ("4", "Löhne (Quartal)", "Wirtschaft", "Lohn", None, 4)]
    ind, mapping = ct.fold_indicators(spark.createDataFrame(rows, "dataset_id string, title string, topic string, raw_name string, unit string, pos int"))
    got = {r["indicator_id"]: (r["name"], r["unit"], r["topic"], r["metrics"]) for r in ind.collect()}
    assert got == {"arbeitslose-frauen": ("Arbeitslose: Frauen", None, "Arbeit", 1), "einwohner-frauen": ("Einwohner: Frauen", "Personen", "Demografie", 1),
                   "lohn": ("Lohn", "Euro", "Arbeit", 2)}
    assert mapping.count() == 4


@pytest.mark.parametrize("geo_n, traffic_n, ort_n, city_n, city_years, kind, geometry", [
    (1, 0, 1, 1, 5, "geo", "line"), (0, 2, 0, 0, 0, "geo", "area"), (0, 0, 1, 9, 5, "choropleth", None), (0, 0, 0, 1, 2, "timeseries", None), (0, 0, 0, 1, 1, "distribution", None)])
def test_kind(spark, geo_n, traffic_n, ort_n, city_n, city_years, kind, geometry):
    df = spark.createDataFrame([(geo_n, traffic_n, ort_n, city_n, city_years, True, ["point", "line"] if geo_n else [], [2001, 2002])],
                               "geo_n int, traffic_n int, ort_n int, city_n int, city_years int, live boolean, geomkinds array<string>, years array<int>")
    row = df.select(ct.entry_kind().alias("k"), ct.entry_badges().alias("b"), ct.entry_geometry().alias("g")).first()
    assert (row["k"], row["g"]) == (kind, geometry) and row["b"][0] == "Live" and row["b"][-1] == "Zeitreihe"


def test_presets(spark):
    df = spark.createDataFrame([
        ("1", "Baumkataster", "umwelt", "geo", []), ("2", "Wahlbezirke 2021", "wahl", "geo", []), ("3", "Wahlbezirke", "wahl", "timeseries", []),
        ("4", "P", "verkehr", "geo", ["park_ride"]), ("5", "Einwohner", "bevoelkerung-und-gesellschaft", "choropleth", [])],
        "group_id string, title string, theme string, kind string, feature_types array<string>")
    got = sorted((r["preset"], r["group_id"]) for r in ct.preset_members(df).collect())
    assert got == [("bevoelkerung", "5"), ("mobilitaet", "4"), ("stadtklima", "1"), ("wahlen", "2")]


def test_counters(spark):
    ddl = "id int, organization string, license string, groups array<string>, resources array<struct<id:string, format:string, datastore_active:boolean>>"
    df = spark.createDataFrame([(1, "o", None, [], [("a", "csv", True), ("b", " ", None)]), (2, "o", "l", ["g", "h"], [])], ddl)
    got = {(r["dimension"], r["value"]): r["n"] for r in ct.package_counters(df).collect()}
    assert got == {("organization", "o"): 2, ("license", "UNKNOWN"): 1, ("license", "l"): 1, ("group", "(No group)"): 1, ("group", "g"): 1, ("group", "h"): 1,
                   ("format", "CSV"): 1, ("format", "UNKNOWN"): 1}
    rated = {r["group"]: r["rate"] for r in ct.group_availability(df).collect()}
    assert rated == {"(No group)": 1.0, "g": 0.0, "h": 0.0}


def test_timeline(spark):
    df = spark.createDataFrame([([2020, 2018],), ([2018, 2025],), ([],)], "years array<int>")
    assert [r["year"] for r in ct.timeline_years(df).collect()] == [2018, 2020, 2025]
