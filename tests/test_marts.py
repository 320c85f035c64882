"""Keyed stream state over batches and a restart; marts by partial aggregates and their switch."""

import datetime as dt

from pyspark.sql import functions as F

from civicspark.streaming import live, marts

DDL = "site_id string, measured_at timestamp, v int"


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def test_newest_from_state_survives_a_restart(spark, tmp_path):
    own = live.stream_session(spark, 2)
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"  # the other session keeps its settings

    def land(i, rows):
        spark.createDataFrame(rows, DDL).coalesce(1).write.parquet(f"{tmp_path}/in/f{i}")

    def drain():
        changes = live.newest_changes(live.file_feed(own, f"{tmp_path}/in/*", DDL, files_per_batch=1), ["site_id"], ["measured_at", "v"], "1 DAY")
        live.start(live.append_sink(changes, f"{tmp_path}/out"), f"{tmp_path}/checkpoint", once=True).awaitTermination()

    land(0, [("a", at(1, 1), 1), ("a", at(1, 2), 2), (None, at(1), 7), ("b", None, 5)])
    drain()
    land(1, [("a", at(1, 2), 2), ("a", at(1, 1), 9), ("b", at(1, 1), 6)])  # a repeat, a late one, a first time
    drain()
    got = sorted((r.site_id or "", r.measured_at, r.v) for r in spark.read.parquet(f"{tmp_path}/out").collect() if r.measured_at)
    assert got == [("", at(1), 7), ("a", at(1, 2), 2), ("b", at(1, 1), 6)]  # nothing was written for repeat and late row


BATCHES = ([("a", at(1), 1), ("b", at(1), 5)], [("a", at(1), 4), ("a", at(2), 2), (None, at(1), 3)], [("c", at(3), 9)])


def days(spark, rows):
    return spark.createDataFrame(rows, DDL).withColumn("day", F.to_date("measured_at"))


def shown(df):
    return sorted(map(str, df.collect()))


def test_mart_equals_its_rebuild(spark, tmp_path):
    folder, mart = str(tmp_path), marts.live_marts("site_id", "measured_at", "v")["daily"]
    for i, rows in enumerate(BATCHES):
        assert marts.refresh(spark, folder, mart, days(spark, rows), i) >= 1
    steady = marts.read(spark, folder, mart)
    before = shown(steady)
    assert marts.refresh(spark, folder, mart, days(spark, BATCHES[2]), 2) == 0  # the same batch again
    # buckets no batch touched keep their files
    first = marts.manifest(spark, folder, mart.name)["buckets"]
    marts.refresh(spark, folder, mart, days(spark, [("c", at(3), 1)]), 3)
    after = marts.manifest(spark, folder, mart.name)["buckets"]
    assert sum(first[b] != after[b] for b in first) == 1
    assert shown(steady) == before  # a reader of the older version still has it whole
    every = [r for rows in BATCHES for r in rows] + [("c", at(3), 1)]
    now = shown(marts.read(spark, folder, mart))
    other = str(tmp_path / "whole")
    marts.rebuild(spark, other, mart, days(spark, every))
    assert now == shown(marts.read(spark, other, mart))
    assert marts.discard(spark, folder, mart.name) >= 0 and shown(marts.read(spark, folder, mart)) == now


def test_failed_write_leaves_the_version(spark, tmp_path):
    folder, mart = str(tmp_path), marts.live_marts("site_id", "measured_at", "v")["latest"]
    marts.refresh(spark, folder, mart, days(spark, BATCHES[0]), 0)
    before = shown(marts.read(spark, folder, mart))
    bad = days(spark, BATCHES[1]).withColumn("v", F.raise_error(F.lit("lost")).cast("int"))
    try:
        marts.refresh(spark, folder, mart, bad, 1)
    except Exception as e:  # noqa: BLE001
        assert "lost" in str(e)
    assert shown(marts.read(spark, folder, mart)) == before and marts.manifest(spark, folder, mart.name)["batch"] == 0
