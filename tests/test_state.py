import random

import pytest
from pyspark.sql import functions as F

from civicspark.operators import state as st


def table(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def got(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


FEATURES = "dataset_id string, dedup_key string, v int"


def test_sweep_drops_untouched_rows_of_the_dataset(spark):
    stored = table(spark, [("a", "1", 0), ("a", "2", 0), ("b", "9", 0)], FEATURES)
    batch = table(spark, [("a", "2", 1), ("a", "3", 1)], FEATURES)
    out = st.replace_snapshot(stored, batch, ["dataset_id"], ["dataset_id", "dedup_key"], [F.desc("v")])
    assert got(out, "dataset_id", "dedup_key", "v") == [("a", "2", 1), ("a", "3", 1), ("b", "9", 0)]


def test_empty_batch_sweeps_nothing(spark):
    stored = table(spark, [("a", "1", 0)], FEATURES)
    out = st.replace_snapshot(stored, stored.where("v > 5"), ["dataset_id"], ["dataset_id", "dedup_key"], [F.desc("v")])
    assert got(out, "dedup_key") == [("1",)]


def test_upsert_without_sweep_keeps_stale_rows(spark):
    stored = table(spark, [("a", "1", 0), ("a", "2", 0)], FEATURES)
    batch = table(spark, [("a", "2", 1), ("a", "2", 2)], FEATURES)
    out = st.merge_latest(stored, batch, ["dataset_id", "dedup_key"], [F.desc("v")])
    assert got(out, "dedup_key", "v") == [("1", 0), ("2", 2)]


def test_missing_unit_keeps_the_stored_one(spark):
    ddl = "k string, metric_value double, metric_unit string"
    stored = table(spark, [("a", 1.0, "EUR"), ("b", 1.0, "EUR"), ("c", 1.0, None)], ddl)
    batch = table(spark, [("a", 2.0, None), ("b", 3.0, "USD"), ("d", 4.0, None)], ddl)
    out = st.merge_statistics(stored, batch, ["k"], F.col("metric_value"))
    assert got(out, "k", "metric_value", "metric_unit") == [("a", 2.0, "EUR"), ("b", 3.0, "USD"), ("c", 1.0, None), ("d", 4.0, None)]


def test_history_is_idempotent(spark):
    ddl = "site string, t timestamp_ntz, v int"
    import datetime as dt

    at = lambda h: dt.datetime(2024, 1, 1, h)
    batch = table(spark, [("a", at(1), 1), ("a", at(1), 1), ("a", at(2), 2), ("b", None, 3)], ddl)
    once = st.append_absent(batch.where("v > 9"), batch, ["site", "t"], "t")
    twice = st.append_absent(once, batch, ["site", "t"], "t")
    assert got(once, "site", "v") == got(twice, "site", "v") == [("a", 1), ("a", 2)]


def test_dedup_key_rules(spark):
    ddl = "id string, props map<string,string>, g string"
    rows = table(spark, [("42", {"x": "1"}, "P"), ("", {"b": "1", "fme_tstamp": "t1"}, "P"), ("", {"fme_tstamp": "t2", "b": "1"}, "P"), ("", {"b": "2", "fme_tstamp": "t1"}, "P"), (None, {"b": "1"}, "Q")], ddl)
    keys = [r["k"] for r in rows.select(st.dedup_key(F.col("id"), F.col("props"), F.col("g"), ("fme_tstamp",)).alias("k")).collect()]
    assert keys[0] == "42" and keys[1] == keys[2] and len(set(keys)) == 4
    strict = [r["k"] for r in rows.select(st.dedup_key(F.col("id"), F.col("props"), F.col("g")).alias("k")).collect()]
    assert strict[1] != strict[2]


def test_top_per_key_with_salt_equals_plain(spark):
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.6 else f"k{i % 5}", rnd.randrange(1000), i) for i in range(2000)]
    df = table(spark, rows, "k string, v int, i int")
    order = [F.desc("v"), F.asc("i")]
    plain = got(st.top_per_key(df, ["k"], order, 40), "k", "v", "i")
    salted = got(st.top_per_key(df, ["k"], order, 40, [F.col("i") % 7]), "k", "v", "i")
    assert plain == salted and len([r for r in plain if r[0] == "hot"]) == 40


def test_previous_value_equals_lag(spark):
    rnd = random.Random(5)
    rows = [("hot" if i % 3 else "cold", rnd.randrange(10), i, rnd.randrange(100)) for i in range(300)]
    df = table(spark, rows, "k string, day int, run int, total int")
    chunked = {r["run"]: r["p"] for r in st.previous_value(df, ["k"], ["day", "run"], "day", "total", "p").collect()}
    want = {}
    for key in ("hot", "cold"):
        last = None
        for _, _, run, total in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            want[run], last = last, total
    assert chunked == want


def test_change_log_accounting(spark):
    rows = [("a", 1, 1, 5, 5), ("a", 1, 2, 3, 6), ("a", 2, 3, 0, 6), ("a", 2, 4, 4, 2), ("b", 1, 5, 0, 0)]
    df = table(spark, rows, "d string, day int, run int, rows_loaded int, rows_total_after int")
    out = st.change_log(df, ["d"], ["day", "run"], "day")
    # run 3 is an idle repeat; run 5 is idle but the first of its dataset
    assert got(out, "run", "rows_added", "rows_updated") == [(1, 5, 0), (2, 1, 2), (4, 0, 4), (5, 0, 0)]


def test_reconcile(spark):
    stored = table(spark, [("a", "x"), ("b", "y"), ("c", None)], "k string, title string")
    config = table(spark, [("a", "x"), ("b", "z"), ("d", "n")], "k string, title string")
    assert got(st.reconcile(stored, config, ["k"]), "k", "action") == [("a", "keep"), ("b", "update"), ("c", "delete"), ("d", "insert")]


def test_upsert_path_rewrites_only_touched_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    ddl = "dataset_id string, dedup_key string, v int"
    keys, order = ["dataset_id", "dedup_key"], [F.desc("v")]
    st.upsert_path(spark, path, table(spark, [("a", "1", 1), ("b", "1", 1)], ddl), keys, order, ["dataset_id"])
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "t" / "dataset_id=b").glob("*.parquet")}
    batch = table(spark, [("a", "1", 2), ("a", "2", 2)], ddl)
    for _ in range(2):  # a retried batch changes nothing
        st.upsert_path(spark, path, batch, keys, order, ["dataset_id"])
        assert got(spark.read.schema(ddl).parquet(path), "dataset_id", "dedup_key", "v") == [("a", "1", 2), ("a", "2", 2), ("b", "1", 1)]
    assert before == {p.name: p.stat().st_mtime_ns for p in (tmp_path / "t" / "dataset_id=b").glob("*.parquet")}
    st.upsert_path(spark, path, table(spark, [("a", "2", 3)], ddl), keys, order, ["dataset_id"], ["dataset_id"])
    assert got(spark.read.schema(ddl).parquet(path), "dataset_id", "dedup_key", "v") == [("a", "2", 3), ("b", "1", 1)]
    with pytest.raises(ValueError):
        st.upsert_path(spark, path, batch, ["dedup_key"], order, ["dataset_id"])


def test_retention_scope(spark):
    import datetime as dt

    df = table(spark, [("a", dt.datetime(2024, 1, 1)), ("b", dt.datetime(2024, 1, 1)), ("a", dt.datetime(2024, 1, 30))], "k string, t timestamp_ntz")
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    assert got(st.within_retention(df, "t", as_of, 7), "k") == [("a",)]
    assert got(st.within_retention(df, "t", as_of, 7, F.col("k") == "a"), "k") == [("a",), ("b",)]


def test_upsert_path_keeps_null_partitions(spark, tmp_path):
    ddl, path = "a string, b string, k string, v int", str(tmp_path / "t")
    keys, order = ["a", "b", "k"], [F.desc("v")]
    st.upsert_path(spark, path, table(spark, [("x", None, "k1", 1), ("x", "y", "k2", 1), (None, None, "k4", 4)], ddl), keys, order, ["a", "b"])
    for _ in range(2):  # a repeated batch changes nothing
        st.upsert_path(spark, path, table(spark, [("x", None, "k3", 2), ("x", "y", "k2", 3), (None, None, "k5", 5)], ddl), keys, order, ["a", "b"])
        got = sorted((r["k"], r["v"]) for r in spark.read.schema(ddl).parquet(path).collect())
        assert got == [("k1", 1), ("k2", 3), ("k3", 2), ("k4", 4), ("k5", 5)]
    st.upsert_path(spark, path, table(spark, [], ddl), keys, order, ["a", "b"])
    assert spark.read.schema(ddl).parquet(path).count() == 5


def test_upsert_path_with_one_null_partition_and_many_others(spark, tmp_path):
    ddl, path = "p int, k string, v int", str(tmp_path / "t")
    first = [(None, "n", 0), *[(i, "s", i) for i in range(600)]]
    st.upsert_path(spark, path, table(spark, first, ddl), ["p", "k"], [F.desc("v")], ["p"])
    st.upsert_path(spark, path, table(spark, [(None, "m", 1), *[(i, "t", i) for i in range(0, 600, 2)]], ddl), ["p", "k"], [F.desc("v")], ["p"])
    assert spark.read.schema(ddl).parquet(path).count() == 601 + 301


def test_newest_reading_survives_a_late_batch(spark):
    ddl = "site string, at int, v int"
    stored, late = table(spark, [("a", 5, 1), ("b", 5, 1)], ddl), table(spark, [("a", 3, 2), ("b", 5, 2)], ddl)
    got = sorted(tuple(r) for r in st.merge_newest(stored, late, ["site"], [F.desc("at")]).collect())
    assert got == [("a", 5, 1), ("b", 5, 2)]
