"""Column functions against worked values."""

import math

import pytest
from pyspark.sql import functions as F

from civicspark.functions import geo, numeric, text as tx


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, want", [
    ("Südost", "sudost"), ("Grünau-Mitte", "grunau-mitte"), ("Straße  des\t17.", "strasse des 17."),
    (None, ""), (" Mitte", " mitte"), ("Île Œuvre", "ile oeuvre")])
def test_norm_name(spark, raw, want):
    assert one(spark, tx.norm_name(F.col("c")), c=raw) == want


@pytest.mark.parametrize("raw, want", [
    ("Straßen & Wege", "strassen-wege"), ("  Ämter (2020) ", "aemter-2020"), ("x" * 80, "x" * 55 + "-46b05b91")])
def test_slugify(spark, raw, want):
    assert one(spark, tx.slugify(F.col("c")), c=raw) == want


@pytest.mark.parametrize("raw, base, year", [
    ("Vornamensstatistik 2022", "vornamenstatistik", 2022), ("Schüler 2001/02", "schüler", 2001),
    ("Wahl 2019 / 2020 - Ergebnis", "wahl ergebnis", 2019), ("Ohne Jahr", "ohne jahr", None), ("Nr 120190", "nr 120190", None)])
def test_title(spark, raw, base, year):
    assert one(spark, tx.title_base(F.col("c")), c=raw) == base
    assert one(spark, tx.title_year(F.col("c")), c=raw) == year


@pytest.mark.parametrize("raw, name, unit", [
    ("Arbeitslose in %", "Arbeitslose", "%"), ("Ärzte je 1.000 Einwohner", "Ärzte", "je 1.000 Einwohner"),
    ("Anteil, in Prozent", "Anteil", "Prozent"), ("Einwohner", "Einwohner", None),
    ("Plätze in " + "x" * 31, "Plätze in " + "x" * 31, None)])
def test_indicator_parts(spark, raw, name, unit):
    canonical, found = tx.indicator_parts(F.col("c"))
    assert (one(spark, canonical, c=raw), one(spark, found, c=raw)) == (name, unit)


@pytest.mark.parametrize("raw, want", [
    ("1,5", 1.5), (" -2.25 ", -2.25), ("1e3", 1000.0), (".5", 0.5), ("5d", None), ("nan", None), ("Infinity", None),
    ("1_000", None), ("", None), ("x", None), (None, None), ("1.234", 1.234), ("1.234,5", None)])
def test_parse_number(spark, raw, want):
    assert one(spark, tx.parse_number(F.col("c")), c=raw) == want


def test_parse_int_truncates(spark):
    assert one(spark, tx.parse_int(F.col("c")), c="-7,9") == -7


@pytest.mark.parametrize("a, b, want", [
    ("grunau-mitte", "mitte", 0.4615), ("zentrum-sudost", "sudost", 0.4667), ("zentrum-nordwest", "nordwest", 0.5294),
    ("ring", "small ring", 5 / 11), ("abc", "abc", 1.0), ("", "abc", 0.0)])
def test_similarity(spark, a, b, want):
    assert one(spark, tx.similarity(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(want, abs=1e-4)


def test_contains_is_literal(spark):
    assert one(spark, tx.contains_text(F.col("c"), "50%"), c="Über 50% mehr") is True
    assert one(spark, tx.contains_text(F.col("c"), "5_%"), c="Über 50% mehr") is False


def test_utm33_golden(spark):
    lon, lat = geo.utm_to_lonlat(F.lit(316626.384556), F.lit(5690467.490877))
    row = spark.range(1).select(lon.alias("lon"), lat.alias("lat")).first()
    assert row["lon"] == pytest.approx(12.367455, abs=1e-6)
    assert row["lat"] == pytest.approx(51.335880, abs=1e-6)


@pytest.mark.parametrize("crs, want", [
    ('{"properties":{"name":"urn:ogc:def:crs:EPSG::25833"}}', 25833), ('{"name":"EPSG:4326"}', 4326), (None, 4326), ("CRS84", 4326)])
def test_epsg(spark, crs, want):
    assert one(spark, geo.epsg_code(F.col("c")), c=crs) == want


def test_area_with_hole(spark):
    square = lambda a, s: [[a, a], [a + s, a], [a + s, a + s], [a, a + s], [a, a]]
    df = spark.createDataFrame([([[square(0.0, 2.0), square(0.5, 1.0)]],)], "coords array<array<array<array<double>>>>")
    area = df.select(geo.spherical_area_m2(F.col("coords")).alias("a")).first()["a"]
    per_degree = (math.pi / 180 * geo.EARTH_RADIUS_M) ** 2
    assert area == pytest.approx(3 * per_degree, rel=1e-3)


def test_pearson_rules(spark):
    rows = [("a", 1.0, 2.0), ("a", 2.0, 4.0), ("a", 3.0, 5.0), ("a", 4.0, 4.0), ("a", 5.0, 5.0),
            ("const", 1.0, 1.0), ("const", 1.0, 2.0), ("one", 1.0, 1.0), ("gap", 1.0, None), ("gap", 2.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r["g"]: r["r"] for r in df.groupBy("g").agg(numeric.pearson(F.col("x"), F.col("y")).alias("r")).collect()}
    assert got["a"] == pytest.approx(0.7745966692414834)
    assert got["const"] is None and got["one"] is None and got["gap"] is None


def test_p_value(spark):
    df = spark.createDataFrame([(0.7745966692414834, 5.0), (1.0, 10.0), (0.0, 10.0), (0.5, 2.0), (None, 9.0)], "r double, n double")
    p = [r["p"] for r in df.select(numeric.pearson_p_value("r", "n").alias("p")).collect()]
    assert 0 < p[0] < 0.2 and p[1] == 0.0 and p[2] == pytest.approx(1.0) and p[3] is None and p[4] is None
    assert p[0] == pytest.approx(0.124027, abs=1e-6)


def test_exact_median_against_sorting(spark):
    rows = [("even", float(v)) for v in (1, 2, 3, 100)] + [("odd", float(v)) for v in (5, 5, 5, 1e12, -3)]
    rows += [("same", 4.0)] * 9 + [("wide", float(i * i)) for i in range(1001)] + [("even", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r["median"] for r in numeric.exact_median(df, ["g"], "v", accuracy=8).collect()}
    assert got == {"even": 2.5, "odd": 5.0, "same": 4.0, "wide": 250000.0}


def test_median_survives_an_outlier(spark):
    df = spark.range(200_001).select(F.lit("g").alias("g"), F.when(F.col("id") == 200_000, 1e12).otherwise(F.col("id")).cast("double").alias("v"))
    assert numeric.exact_median(df, ["g"], "v").first()["median"] == 100_000.0


def test_p_value_of_any_size(spark):
    df = spark.createDataFrame([(0.5, 3.0), (0.999, 3.0), (0.2, 100.0), (1.96 / 1e5, 1e10)], "r double, n double")
    p = [r["p"] for r in df.select(numeric.pearson_p_value("r", "n").alias("p")).collect()]
    assert p[0] == pytest.approx(2 / 3, abs=1e-9)  # one degree of freedom: an arc sine
    assert p[1] == pytest.approx(2 / math.pi * math.acos(0.999), abs=1e-12)
    df98, t = 98, 0.2 * math.sqrt(98 / 0.96)
    size = math.exp(math.lgamma((df98 + 1) / 2) - math.lgamma(df98 / 2)) / math.sqrt(df98 * math.pi)
    step = t / 100_000  # the density summed from 0 to t
    inner = sum(size * (1 + ((i + 0.5) * step) ** 2 / df98) ** (-(df98 + 1) / 2) for i in range(100_000)) * step
    assert p[2] == pytest.approx(1 - 2 * inner, abs=1e-9)
    assert p[3] == pytest.approx(math.erfc(1.96 / math.sqrt(2)), abs=1e-4)


def test_long_slugs_stay_different(spark):
    texts = ["einwohner " * 20 + "a", "einwohner " * 20 + "b", "Kurz & gut"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "t string").select(tx.slugify(F.col("t"))).collect()]
    assert len(set(got)) == 3 and got[2] == "kurz-gut" and all(len(g) <= 64 for g in got)


def test_numbers_are_finite(spark):
    got = [r[0] for r in spark.createDataFrame([("1e400",), ("1,5",)], "t string").select(tx.parse_number(F.col("t"))).collect()]
    assert got == [None, 1.5]
