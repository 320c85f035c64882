"""Streams drained over several micro-batches give the batch answer."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from civicspark.streaming import live

DDL = "site_id string, measured_at timestamp, v int"


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def feed(spark, folder, *files):
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, DDL).coalesce(1).write.parquet(f"{folder}/in/f{i}")
    return live.file_feed(spark, f"{folder}/in/*", DDL, files_per_batch=1)


def drain(writer, folder):
    live.start(writer, f"{folder}/checkpoint", once=True).awaitTermination()


BATCHES = (
    [("a", at(1, 1), 1), ("a", at(1, 2), 2), ("b", at(1, 1), 5)],
    [("a", at(1, 2), 2), ("a", at(2, 1), 3), ("b", None, 9)],  # re-published, and one without a time
    [("b", at(1, 0), 4), ("a", at(2, 1), 3)],  # late
)


def test_latest_per_site(spark, tmp_path):
    rows = live.with_bucket(feed(spark, tmp_path, *BATCHES).where("measured_at is not null"), "site_id", 4)
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    writer = live.keyed_sink(rows, out, ["bucket", "site_id"], lambda: [F.desc("measured_at")], ["bucket"], log=log)
    drain(writer, tmp_path)
    # the newest reading wins, whichever batch brings it
    got = {r["site_id"]: r["v"] for r in spark.read.parquet(out).collect()}
    assert got == {"a": 3, "b": 5}
    assert spark.read.parquet(log).agg(F.sum("rows_loaded")).first()[0] == 7


def test_history_is_unique_across_batches(spark, tmp_path):
    once = live.unique_readings(feed(spark, tmp_path, *BATCHES), ["site_id", "measured_at"], "measured_at")
    out = str(tmp_path / "out")
    drain(live.append_sink(once, out), tmp_path)
    got = sorted((r["site_id"], r["measured_at"], r["v"]) for r in spark.read.parquet(out).collect())
    assert got == sorted({r for b in BATCHES for r in b if r[1] is not None})


def test_history_with_expiry_runs_without_python(spark, tmp_path, monkeypatch, capsys):
    # one reading a day, but for day 3, under keys that expire after a day: repeats keep a key alive beyond its first day
    moment = lambda day: F.lit(at(day, 6)).cast("timestamp")
    own, out = live.stream_session(spark, 2), str(tmp_path / "out")
    passed = []
    for day, rows in enumerate(([("a", at(1), 1), ("a", at(1), 1), ("b", at(1), 2)], [("a", at(1), 1), ("c", None, 3)], [("a", at(1), 1), (None, at(1), 4)],
                                [], [("a", at(1), 1), ("b", at(1), 2)]), 1):
        if not rows:
            continue
        spark.createDataFrame(rows, DDL).coalesce(1).write.parquet(f"{tmp_path}/in/f{day}")
        monkeypatch.setattr(live.F, "current_timestamp", lambda day=day: moment(day))
        once = live.unique_readings(live.file_feed(own, f"{tmp_path}/in/*", DDL), ["site_id", "measured_at"], "measured_at", ttl="1 DAY")
        drain(live.append_sink(once, out), tmp_path)
        passed.append(sorted((r["site_id"] or "", r["v"]) for r in spark.read.parquet(out).collect()))
    assert once.columns == ["site_id", "measured_at", "v"]
    assert passed == [[("a", 1), ("b", 2)], [("a", 1), ("b", 2)], [("", 4), ("a", 1), ("b", 2)],
                      [("", 4), ("a", 1), ("a", 1), ("b", 2), ("b", 2)]]
    once.explain()
    assert "InPySpark" not in capsys.readouterr().out


def test_daily_totals_count_late_readings(spark, tmp_path):
    daily = live.daily_totals(feed(spark, tmp_path, *BATCHES).where("measured_at is not null"), "site_id", "measured_at", F.col("v"))
    out = str(tmp_path / "out")
    drain(live.keyed_sink(daily, out, ["day", "site_id"], lambda: [F.desc("readings")], ["day"], mode="update"), tmp_path)
    got = {(r["site_id"], r["day"].day): (r["total"], r["readings"]) for r in spark.read.parquet(out).collect()}
    assert got == {("a", 1): (5, 3), ("b", 1): (9, 2), ("a", 2): (6, 2)}


def test_snapshot_sweep(spark, tmp_path):
    # v is the snapshot's id: the first spans two batches, the second leaves out a key of site a, then a late part of the first comes
    batches = ([("a", at(1), 1), ("b", at(1), 1)], [("a", at(2), 1), ("a", at(3), 1)], [("a", at(2), 2)], [("a", at(3), 2), ("a", at(4), 1)])
    rows = feed(spark, tmp_path, *batches).withColumn("k", F.date_format("measured_at", "dd"))
    out = str(tmp_path / "out")
    sink = lambda stream: live.keyed_sink(stream, out, ["site_id", "k"], lambda: [F.desc("measured_at")], ["site_id"], ["site_id"], snapshot="v")
    drain(sink(rows.where("v < 2 and k < '04'")), tmp_path)
    assert spark.read.parquet(out).count() == 4  # both batches of the first snapshot
    live.start(sink(rows), f"{tmp_path}/checkpoint2", once=True).awaitTermination()
    assert sorted((r["site_id"], r["k"], r["v"]) for r in spark.read.parquet(out).collect()) == [("a", "02", 2), ("a", "03", 2), ("b", "01", 1)]


def test_snapshot_needs_an_id(spark, tmp_path):
    with pytest.raises(ValueError):
        live.keyed_sink(feed(spark, tmp_path, BATCHES[0]), "x", ["site_id"], list, ["site_id"], ["site_id"])


def test_refresh_only_live_marts(spark, tmp_path):
    marts = {"live": spark.range(3), "slow": spark.range(4)}
    assert live.refresh_marts(marts, str(tmp_path), {"live"}) == ["live"]
    assert not (tmp_path / "slow").exists()
    assert live.refresh_marts(marts, str(tmp_path)) == ["live", "slow"]
    assert spark.read.parquet(str(tmp_path / "slow")).count() == 4
