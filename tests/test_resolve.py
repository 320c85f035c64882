import random
import string

import pytest
from pyspark.sql import functions as F

from civicspark.operators import resolve as rv

LEVELS = [
    ("ortsteil", "62", "Grünau-Mitte"), ("ortsteil", "02", "Zentrum-Südost"), ("ortsteil", "05", "Zentrum-Nordwest"), ("ortsteil", "00", "Zentrum"),
    ("ortsteil", "21", "Schönefeld-Abtnaundorf"), ("stadtbezirk", "0", "Mitte"), ("stadtbezirk", "3", "Südost"), ("stadtbezirk", "8", "Nordwest")]


@pytest.fixture(scope="module")
def bounds(spark):
    return spark.createDataFrame([(*r, None, 0) for r in LEVELS], "boundary_type string, code string, name string, parent_code string, boundary_year int")


def resolve(spark, bounds, pairs, aliases=None):
    keys = spark.createDataFrame(pairs, "unit string, raw string")
    out = rv.resolve_keys(keys, bounds, aliases if aliases is not None else rv.derive_aliases(bounds))
    return {(r["unit"], r["raw"]): (r["code"], r["prio"]) for r in out.collect()}


def test_cascade(spark, bounds):
    got = resolve(spark, bounds, [
        ("ortsteil", "ZENTRUM"), ("ortsteil", " 21 "), ("ortsteil", "62 Grünau Mitte"), ("ortsteil", "Schönefeld-Abtnaundrf"),
        ("ortsteil", "0"), ("ortsteil", "Völlig anders"), ("stadtbezirk", "sudost"), ("stadtbezirk", "3")])
    assert got == {
        ("ortsteil", "ZENTRUM"): ("00", 1), ("ortsteil", " 21 "): ("21", 2), ("ortsteil", "62 Grünau Mitte"): ("62", 3),
        ("ortsteil", "Schönefeld-Abtnaundrf"): ("21", 4), ("ortsteil", "0"): ("00", 1), ("ortsteil", "Völlig anders"): (None, None),
        ("stadtbezirk", "sudost"): ("3", 1), ("stadtbezirk", "3"): ("3", 1)}


def test_names_of_another_level_do_not_match_fuzzily(spark, bounds):
    got = resolve(spark, bounds, [("ortsteil", "Mitte"), ("ortsteil", "Südost"), ("ortsteil", "Nordwest")])
    assert set(got.values()) == {(None, None)}


def test_repair_clears_foreign_codes(spark, bounds):
    stats = spark.createDataFrame([("ortsteil", "Mitte", "62"), ("ortsteil", "Grünau-Mitte", "62"), ("stadtbezirk", "Mitte", "0")],
                                  "spatial_unit string, spatial_key string, spatial_code string")
    got = sorted((r["spatial_unit"], r["spatial_key"], r["spatial_code"]) for r in rv.repair_foreign(stats, bounds).collect())
    assert got == [("ortsteil", "Grünau-Mitte", "62"), ("ortsteil", "Mitte", None), ("stadtbezirk", "Mitte", "0")]


def test_aliases_newest_year_and_manual(spark):
    b = spark.createDataFrame([("w", "0019", "Nord", 2021), ("w", "0020", "Nord", 2025), ("w", "0000", None, 2025)],
                              "boundary_type string, code string, name string, boundary_year int")
    manual = spark.createDataFrame([("w", "20", "9999")], "unit_type string, alias string, code string")
    got = {r["alias"]: (r["code"], r["source"]) for r in rv.derive_aliases(b, manual).collect()}
    assert got == {"nord": ("0020", "boundary"), "19": ("0019", "boundary"), "20": ("9999", "manual"), "0": ("0000", "boundary")}


def test_shared_names_are_reported(spark, bounds):
    assert rv.shared_names(bounds).isEmpty()
    clash = bounds.unionByName(spark.createDataFrame([("stadtbezirk", "9", "zentrum", None, 0)], bounds.schema))
    assert [r["norm"] for r in rv.shared_names(clash).collect()] == ["zentrum"]


def _grams(text):
    out, word = set(), ""
    for ch in text + " ":
        if ch.isalnum():
            word += ch
        elif word:
            padded = f"  {word} "
            out |= {padded[i:i + 3] for i in range(len(padded) - 2)}
            word = ""
    return out


@pytest.mark.parametrize("threshold", [0.2, 0.45, 0.6])
def test_prefix_filter_loses_no_pair(spark, threshold):
    """Brute force over all pairs; a third of the names share a hot word."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice(string.ascii_lowercase[:6]) for _ in range(rnd.randint(2, 7)))
    names = sorted({("zentrum " if rnd.random() < 0.35 else "") + word() + (" " + word() if rnd.random() < 0.4 else "") for _ in range(160)})
    left, right = names[::2], names[1::2]
    want = set()
    for a in left:
        for b in right:
            ga, gb = _grams(a), _grams(b)
            if len(ga & gb) / len(ga | gb) > threshold:
                want.add((a, b))
    l_df = spark.createDataFrame([("u", n) for n in left], "unit string, left_name string")
    r_df = spark.createDataFrame([("u", n) for n in right], "unit string, right_name string")
    got = {(r["left_name"], r["right_name"]) for r in rv.trigram_join(l_df, r_df, threshold).collect()}
    assert got == want
    assert want or threshold > 0.5


def _crowded_names(n):
    """Names of two words; a third of them share their first one, and with it seven grams."""
    rnd = random.Random(23)
    word = lambda k: "".join(rnd.choice(string.ascii_lowercase) for _ in range(k))
    return sorted({("zentral " if rnd.random() < 0.34 else word(5) + " ") + word(rnd.randint(5, 11)) for _ in range(n)})


def test_a_hot_gram_brings_few_candidates(spark):
    names = _crowded_names(1500)
    other = [n[:-1] + "x" for n in names]
    l_df = spark.createDataFrame([("u", n) for n in names], "unit string, left_name string")
    r_df = spark.createDataFrame([("u", n) for n in other], "unit string, right_name string")
    found = rv.trigram_join(l_df, r_df).count()
    candidates = rv.trigram_candidates(l_df, r_df).count()
    assert found >= len(names)
    assert candidates <= 3 * found, (candidates, found)


@pytest.mark.parametrize("hot_rows", [1, 7])
def test_pieces_of_a_hot_gram_lose_no_pair(spark, hot_rows):
    names = _crowded_names(150)
    l_df = spark.createDataFrame([("u", n) for n in names[::2]] + [(None, "zentral"), ("u", None), ("u", "")], "unit string, left_name string")
    r_df = spark.createDataFrame([("u", n) for n in names[1::2]] + [(None, "zentral"), ("u", None), ("u", "")], "unit string, right_name string")
    whole = rv.trigram_candidates(l_df, r_df)
    cut = rv.trigram_candidates(l_df, r_df, hot_rows=hot_rows)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cut.collect()))
    assert whole.where("unit is null or left_name is null").count() == 0


def test_boundary_gate(spark):
    feats = spark.createDataFrame([({"OT": str(i), "Name": "n"},) for i in range(9)] + [({"OT": " "},)], "props map<string,string>")
    rows = rv.boundary_rows(feats, ["OT", "SBZ"], ["Name"], "ortsteil")
    rv.require_boundary_quality(rows)
    with pytest.raises(ValueError):
        rv.require_boundary_quality(rows, 0.95)
    with pytest.raises(ValueError):
        rv.require_boundary_quality(rows.where("code = 'none'"))
    assert {r["parent_code"] for r in rows.where(F.col("code").isNotNull()).collect()} == {str(i) for i in range(9)}
