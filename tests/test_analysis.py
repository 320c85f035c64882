import random

import pytest
from pyspark.sql import functions as F

from civicspark.operators import analytics as an, elections as el, profiling as pf


def test_shares_skip_missing_and_zero(spark):
    rows = [("00", "Einwohner", 1000.0), ("00", "Arbeitslose", 50.0), ("00", "Ausländer", 200.0), ("00", "Familien", 400.0), ("00", "Allein", 100.0),
            ("01", "Einwohner", 0.0), ("01", "Arbeitslose", 5.0)]
    df = spark.createDataFrame(rows, "code string, metric_name string, metric_value double")
    ratios = {"u": ("Arbeitslose", "Einwohner"), "f": ("Ausländer", "Einwohner"), "s": ("Allein", "Familien")}
    got = {r["code"]: (r["u"], r["f"], r["s"]) for r in an.compute_shares(df, ["code"], ratios).collect()}
    assert got == {"00": (0.05, 0.2, 0.25), "01": (None, None, None)}


def test_rollup_recomputes_the_share(spark):
    rows = [("00", "Einwohner", 1000.0), ("00", "Arbeitslose", 100.0), ("01", "Einwohner", 3000.0), ("01", "Arbeitslose", 60.0), ("99", "Einwohner", 7.0)]
    counts = spark.createDataFrame(rows, "spatial_code string, metric_name string, metric_value double")
    parents = spark.createDataFrame([("00", "0"), ("01", "0"), ("98", None)], "code string, parent_code string")
    up = an.rollup_to_parent(counts, parents)
    assert sorted((r["spatial_code"], r["metric_name"], r["metric_value"]) for r in up.collect()) == [("0", "Arbeitslose", 160.0), ("0", "Einwohner", 4000.0)]
    share = an.compute_shares(up, ["spatial_code"], {"u": ("Arbeitslose", "Einwohner")}).first()["u"]
    assert share == pytest.approx(0.04)
    checked = an.validate_rollup(up, up.withColumn("metric_value", F.col("metric_value") + F.when(F.col("metric_name") == "Einwohner", 0.6).otherwise(0.4)), ["spatial_code", "metric_name"]).first()
    assert (checked["compared"], checked["mismatches"]) == (2, 1)


def test_conflicting_duplicates(spark):
    same = spark.createDataFrame([("00", "E", 1.0), ("00", "E", 1.0)], "spatial_code string, metric_name string, metric_value double")
    assert an.conflicting_duplicates(same, ["spatial_code", "metric_name"]).isEmpty()
    assert an.build_counts(same, ["spatial_code", "metric_name"]).count() == 1
    clash = same.unionByName(spark.createDataFrame([("00", "E", 2.0)], same.schema))
    assert an.conflicting_duplicates(clash, ["spatial_code", "metric_name"]).count() == 1
    with pytest.raises(Exception, match="conflicting duplicate: 00 E"):
        an.build_counts(clash, ["spatial_code", "metric_name"]).collect()


def _stats(spark, rows):
    full = [(d, "year", f"{q}.Qu. {y}", y, q, None, u, k, c, m, v, None) for d, u, k, c, m, y, q, v in rows]
    from civicspark.schemas import STATISTICS

    return spark.createDataFrame(full, STATISTICS)


def test_newest_common_year_and_quarter(spark):
    s = _stats(spark, [
        ("x", "ot", "A", "1", "a", 2020, 1, 1.0), ("x", "ot", "A", "1", "a", 2021, 1, 5.0), ("x", "ot", "B", "2", "a", 2020, 1, 2.0), ("x", "ot", "B", "2", "a", 2020, 4, 3.0),
        ("x", "ot", "A", "1", "b", 2020, 2, 10.0), ("x", "ot", "B", "2", "b", 2020, 1, 20.0), ("x", "ot", "C", None, "b", 2022, 1, 20.0), ("y", "ot", "A", "1", "a", 2020, 1, 99.0)])
    pairs = an.paired_areas(an.of_metric(s, "a", "ot", "x"), an.of_metric(s, "b", "ot"))
    assert sorted((r["spatial_code"], r["value_a"], r["value_b"]) for r in pairs.collect()) == [("1", 1.0, 10.0), ("2", 3.0, 20.0)]
    got = an.correlation_summary(pairs).first()
    assert got["n"] == 2 and got["pearson_r"] == pytest.approx(1.0)
    # without a dataset the colliding name is settled by dataset id
    loose = an.paired_areas(an.of_metric(s, "a", "ot"), an.of_metric(s, "b", "ot"))
    assert {r["value_a"] for r in loose.collect()} == {1.0, 3.0}


def test_latest_ties_by_label(spark):
    s = _stats(spark, [("x", "ot", "A", "1", "a", 2003, None, 1.0)]).withColumn("period_label", F.lit("1.Qu. 2003"))
    s = s.unionByName(s.withColumn("period_label", F.lit("2.Qu. 2003")).withColumn("metric_value", F.lit(2.0)))
    assert an.statistics_latest(s).first()["metric_value"] == 2.0


def test_grid_equals_pairwise(spark):
    rnd = random.Random(2)
    areas = [f"{i:02d}" for i in range(12)]
    x = {(a, s): rnd.random() for a in areas for s in ("cdu", "spd")}
    y = {(a, i): rnd.random() for a in areas for i in ("u", "f") if rnd.random() < 0.8}
    y[("00", "rare")] = 1.0
    wide = spark.createDataFrame([(a, x[a, "cdu"], x[a, "spd"]) for a in areas], "code string, cdu double, spd double")
    long = spark.createDataFrame([(a, i, v) for (a, i), v in y.items()], "code string, indicator string, value double")
    got = {(r["indicator"], r["series"]): r["r"] for r in an.correlation_grid(wide, "code", ["cdu", "spd"], long, ["indicator"], "value").collect()}
    assert set(got) == {(i, s) for i in ("u", "f") for s in ("cdu", "spd")}
    import numpy as np

    for (i, s), r in got.items():
        common = [a for a in areas if (a, i) in y]
        assert r == pytest.approx(np.corrcoef([x[a, s] for a in common], [y[a, i] for a in common])[0, 1])


@pytest.mark.parametrize("degree", [1, 2, 3])
def test_polynomial_fit(spark, degree):
    import numpy as np

    xs = [i / 3 + 1000 for i in range(30)]
    ys = [2 + 0.5 * (v - 1000) - 0.3 * (v - 1000) ** 2 + 0.01 * (v - 1000) ** 3 + (i % 5) for i, v in enumerate(xs)]
    rows = [("g", a, b) for a, b in zip(xs, ys)] + [("flat", 1.0, float(i)) for i in range(9)] + [("const", float(i), 4.0) for i in range(9)]
    rows += [("few", float(i), float(i * i)) for i in range(degree + 1)]
    fit = an.polynomial_fit(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y", degree)
    got = {r["k"]: r for r in fit.collect()}
    assert got["flat"]["coeffs"] is None and got["const"]["r2"] is None and got["few"]["coeffs"] is None
    want = np.polynomial.Polynomial.fit(xs, ys, degree)
    residual = sum((b - want(a)) ** 2 for a, b in zip(xs, ys))
    assert got["g"]["r2"] == pytest.approx(1 - residual / sum((b - np.mean(ys)) ** 2 for b in ys))
    curve = an.trend_curve(fit.where("k = 'g'"), ["k"]).orderBy("step").collect()
    assert len(curve) == 101
    for r in (curve[0], curve[50], curve[100]):
        assert r["y"] == pytest.approx(want(r["x"]))


def test_spectrum_goldens(spark):
    ddl = "area string, party_key string, party_name string, party_position double, party_color string, share_pct double, turnout_pct double"
    rows = [("even", "linke", "Linke", -1.0, "c", 50.0, 70.0), ("even", "cdu", "CDU", 0.6, "c", 50.0, 70.0),
            ("part", "linke", "Linke", -1.0, "c", 40.0, None), ("part", None, "X", None, None, 5.5, None), ("part", None, "Y", None, None, 4.5, None),
            ("none", None, "X", None, None, 5.5, None), ("null", "cdu", "CDU", 0.6, "c", None, None)]
    got = {r["area"]: r for r in el.spectrum(spark.createDataFrame(rows, ddl), ["area"]).collect()}
    assert (got["even"]["score"], got["even"]["coverage_pct"]) == (-0.2, 100.0)
    assert (got["part"]["score"], got["part"]["coverage_pct"]) == (-1.0, 40.0)
    assert [(p["name"], p["share"]) for p in got["part"]["parties"]] == [("Linke", 40.0), ("Sonstige", 10.0)]
    assert got["none"]["score"] is None and got["none"]["coverage_pct"] == 0.0
    assert got["null"]["score"] is None and got["null"]["parties"] == []


def test_match_columns_is_greedy(spark):
    cols = spark.createDataFrame([("w", 1, 20.001), ("w", 2, 20.005), ("w", 3, 9.0), ("v", 1, 1.0)], "election_id string, idx int, share double")
    named = spark.createDataFrame([("w", "A", 20.0), ("w", "B", 20.02), ("w", "C", 9.5)], "election_id string, name string, ref double")
    got = sorted((r["election_id"], r["idx"], r["label"]) for r in el.match_columns(cols, named).collect())
    # column 2 is nearest to A too, but A is taken, and B lies inside the tolerance
    assert got == [("v", 1, "Liste 1"), ("w", 1, "A"), ("w", 2, "B"), ("w", 3, "Liste 3")]


def test_percent_rounds_half_up(spark):
    df = spark.createDataFrame([(201, 20000), (1, 3), (5, 0)], "a long, b long")
    assert [r["p"] for r in df.select(el.percent(F.col("a"), F.col("b")).alias("p")).collect()] == [1.01, 33.33, None]


def test_histogram_edges(spark):
    rows = [("a", float(v)) for v in range(21)] + [("same", 3.0)] * 4 + [("a", None), ("empty", None)]
    got = pf.histogram(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()
    a = sorted((r["bucket"], r["n"]) for r in got if r["g"] == "a")
    assert len(a) == 20 and a[19][1] == 2 and sum(n for _, n in a) == 21
    assert [(r["lo"], r["hi"], r["n"]) for r in got if r["g"] == "same"] == [(3.0, 3.0, 4)]
    assert not [r for r in got if r["g"] == "empty"]
    gaps = pf.histogram(spark.createDataFrame([("g", 0.0), ("g", 100.0)], "g string, v double"), ["g"], "v").collect()
    assert sorted(r["n"] for r in gaps) == [0] * 18 + [1, 1]


def test_property_profile(spark):
    rows = [(str(i), '{"h":"%s","art":"%s"}' % (f"{i},5" if i else "x", "Linde" if i % 2 else "Ahorn")) for i in range(10)] + [("n", None)]
    feats = spark.createDataFrame(rows, "feature_id string, properties string")
    keys = pf.property_keys(feats)
    assert {r["key"]: (r["n"], r["is_numeric"]) for r in keys.collect()} == {"h": (10, True), "art": (10, False)}
    numeric, top = pf.profile_properties(feats, keys)
    n = numeric.first()
    assert (n["n"], n["non_null"], n["median"], n["max"]) == (10, 9, 5.5, 9.5)
    assert [(r["value"], r["n"]) for r in top.orderBy("value").collect()] == [("Ahorn", 5), ("Linde", 5)]


def test_versioned_boundaries(spark):
    rows = spark.createDataFrame([("w", "1", 2021), ("w", "1", 2025), ("o", "1", 2025)], "spatial_unit string, spatial_code string, period_year int")
    b = spark.createDataFrame([("w", "1", "alt", 2021), ("w", "1", "neu", 2025), ("o", "1", "ort", 0)], "boundary_type string, code string, name string, boundary_year int")
    got = sorted((r["spatial_unit"], r["period_year"], r["boundary_name"]) for r in an.versioned_boundaries(rows, b).collect())
    assert got == [("o", 2025, "ort"), ("w", 2021, "alt"), ("w", 2025, "neu")]
