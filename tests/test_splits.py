"""Splittable readers: the same rows as a reader that takes a whole file, with splits of a few bytes."""

import json
import random

import pytest
from pyspark.sql import functions as F

from civicspark.sources import delimited, jsonfiles, splits


@pytest.fixture(params=[1500, 1 << 27])
def small_splits(spark, request):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield request.param
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def cell(rng):
    plain = "".join(rng.choice("ab ö,;x") for _ in range(rng.randrange(6)))
    if rng.random() < 0.5:
        return '"' + (plain + rng.choice(["", '""', "\n", "\n\n", ',"",', '""\n;'])) * rng.randrange(1, 6) + '"'
    return plain.replace(",", "") + rng.choice(["", "", '"', ' "q'] if plain.strip(" ,") else [""])


def table(seed, rows=60):
    rng = random.Random(seed)
    body = "".join(",".join([str(i), *(cell(rng) for _ in range(3))]) + rng.choice(["\n", "\n\n"]) for i in range(rows))
    return '﻿id,"na\nme",b,c\n' + body


def whole(spark, path, separator=","):
    raw = spark.read.option("header", True).option("sep", separator).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    names = [c.replace("﻿", "").strip() for c in raw.columns]
    raw = raw.toDF(*names)
    return [tuple(r) for r in raw.select(*[F.trim(F.translate(F.col(f"`{c}`"), "\0", "")).alias(c) for c in names]).collect()], names


@pytest.mark.parametrize("seed", [1])
def test_quoted_csv(spark, tmp_path, small_splits, seed):
    (tmp_path / "a.csv").write_bytes(table(seed).encode())
    df = delimited.read_delimited(spark, str(tmp_path / "a.csv"), ",", "UTF-8", order="_at")
    want, names = whole(spark, str(tmp_path / "a.csv"))
    got = [tuple(r)[:-1] for r in df.orderBy("_at").collect()]
    assert df.columns == [*names, "_at"] and got == want and len(got) == 60


def test_line_ends(spark, tmp_path, small_splits):
    """A file of a Windows machine has the same cells, as many of its records span lines."""
    (tmp_path / "a.csv").write_bytes(b'a,b\r\n"1\r\n""2""",x\r\n\r\n3,"y,\r\n"\r\n' * 1 + b'4,z\r\n' * 40)
    got = [tuple(r) for r in delimited.read_delimited(spark, str(tmp_path), order="_at").orderBy("_at").select("a", "b").collect()]
    assert got == [('1\n"2"', "x"), ("3", "y,\n")] + [("4", "z")] * 40


def test_latin1_and_several_files(spark, tmp_path, small_splits):
    for k in range(3):
        (tmp_path / f"{k}.csv").write_bytes(("n;t\n" + "".join(f'{k}-{i};"Größe\n{i} ""x"""\n' for i in range(30))).encode("latin-1" if k else "utf-8"))
    got = sorted(tuple(r) for r in delimited.read_delimited(spark, str(tmp_path)).collect())
    assert got == sorted((f"{k}-{i}", f'Größe\n{i} "x"') for k in range(3) for i in range(30))


def test_open_quote_takes_the_rest(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text("a,b\n1,x\n2,\"open\n3,y\n4,z\n" + "5,w\n" * 40)
    got = [tuple(r) for r in splits.csv_records(spark, str(tmp_path / "a.csv"), ",").orderBy("start", "seq").select(F.col("text").cast("string")).collect()]
    assert len(got) == 3 and got[2][0].startswith('2,"open\n3,y') and got[2][0].endswith("5,w")


def test_large_files_are_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "a.csv").write_text(table(3, 400))
    (tmp_path / "a.json").write_text(json.dumps([{"a": "x" * 50, "i": i} for i in range(400)]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert splits._split_rows(spark, str(tmp_path / "a.csv")).rdd.getNumPartitions() >= 5
        pieces = splits._split_rows(spark, str(tmp_path / "a.json"), "}")
        assert pieces.rdd.getNumPartitions() >= 10 and pieces.select("start").distinct().count() >= 10
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def thing(rng, depth=0):
    kind = rng.randrange(5 if depth < 3 else 3)
    if kind == 0:
        return rng.choice([None, True, 12, -3.5])
    if kind < 3:
        return "".join(rng.choice(["a", "}", "{", "]", "[", '"', "\\", "\\\\\"", ":", ",", "ä", "\n", '"values":[']) for _ in range(rng.randrange(8)))
    if kind == 3:
        return [thing(rng, depth + 1) for _ in range(rng.randrange(3))]
    return {rng.choice(["a", "values", "x}y", "features"]) + str(k): thing(rng, depth + 1) for k in range(rng.randrange(3))}


def objects(seed, n):
    rng = random.Random(seed)
    return [{"i": i, "t": thing(rng), "u": {"v": thing(rng)}} for i in range(n)]


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("form", ["list", "envelope", "single"])
def test_json_records(spark, tmp_path, small_splits, form, indent):
    rows = objects(7, 30)
    if form == "single":
        doc, want = {"other": rows[:12], "crs": {"n": 1}}, [{"other": rows[:12], "crs": {"n": 1}}]
    else:
        doc = rows if form == "list" else {"meta": {"a": [{"no": 1}], "values": [{"no": 2}]}, "links": [{"no": 3}], "values": rows, "end": {"no": {"x": [{}]}}}
        want = rows
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=False))
    found, members = splits.json_records(spark, str(tmp_path / "a.json"), ("values", "data"))
    got = [json.loads(r.text) for r in found.orderBy("start", "seq").collect()]
    assert got == want
    if form == "envelope":
        assert sorted(r.name for r in members.collect()) == ["links", "values", "{end", "{meta"]


def test_records_read_like_a_whole_document(spark, tmp_path, small_splits):
    rows = [{"a": i, "b": f"x{i} }}", "n": {"k": [i]}} for i in range(50)]
    for name, doc in (("l", rows), ("v", {"n": 1, "values": rows}), ("d", {"values": None, "data": rows}), ("b", {"data": [{"z": 1}], "values": rows})):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
        df = jsonfiles.read_records(spark, str(tmp_path / f"{name}.json"), order="_row")
        got = [(r["a"], r["b"], r["n"]["k"]) for r in df.orderBy("_row").collect()]
        assert got == [(str(i), f"x{i} }}", [str(i)]) for i in range(50)], name
    (tmp_path / "none.json").write_text("[]")
    assert jsonfiles.read_records(spark, str(tmp_path / "none.json")).count() == 0


@pytest.mark.parametrize("crs_first", [True, False])
def test_collections(spark, tmp_path, small_splits, crs_first):
    crs = {"crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::25833"}}}
    feats = {"features": [{"type": "Feature", "id": f"f{i}", "properties": {"crs": {"name": "EPSG:4326"}, "t": "}]{["},
                           "geometry": {"type": "LineString", "coordinates": [[316626.38 + k, 5690467.49 + i] for k in range(20)]}} for i in range(25)]}
    doc = {"type": "FeatureCollection", **(crs | feats if crs_first else feats | crs)}
    (tmp_path / "a.geojson").write_text(json.dumps(doc))
    rows = jsonfiles.read_geojson(spark, str(tmp_path / "a.geojson"), order="_at").orderBy("_at").collect()
    assert [r.feature_id for r in rows] == [f"f{i}" for i in range(25)] and {r.epsg for r in rows} == {25833}
    assert all(len(r.coords[0][0]) == 20 and 12 < r.coords[0][0][0][0] < 13 for r in rows)


def test_bare_features_and_empty_collections(spark, tmp_path):
    one = {"type": "Feature", "id": "a", "geometry": {"type": "Point", "coordinates": [12.3, 51.3]}, "properties": None}
    (tmp_path / "a.json").write_text(json.dumps(one))
    (tmp_path / "b.json").write_text(json.dumps({"type": "FeatureCollection", "features": []}))
    (tmp_path / "c.json").write_text("\n".join(json.dumps(one | {"id": x}) for x in "bc"))
    rows = jsonfiles.read_geojson(spark, str(tmp_path)).collect()
    assert sorted(r.feature_id for r in rows) == ["a", "b", "c"]
