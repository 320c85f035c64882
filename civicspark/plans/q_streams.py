"""Streaming queries: the events file as a live feed, drained to completion, equal to the batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicspark.operators import analytics as an
from civicspark.plans import roles
from civicspark.plans.registry import Tables, query
from civicspark.plans.roles import ctes
from civicspark.session import work_path
from civicspark.streaming import live, marts


def _session(t: Tables):
    return live.stream_session(t.spark, t.spark.sparkContext.defaultParallelism)


def _feed(t: Tables):
    events = live.file_feed(_session(t), t.sf_dir, t.events.schema, glob="events.parquet")
    return events.select(
        F.col("user_id").cast("string").alias("site_id"), "event_id", "event_type", F.col("value").alias("occupied"),
        F.col("ts").cast("timestamp").alias("measured_at"))


def _drain(t: Tables, writer, name: str) -> None:
    live.start(writer, work_path(t.spark, f"{name}-checkpoint"), once=True).awaitTermination()


def _landed(t: Tables, files: int):
    """The events landed as several files in no order of time, one per micro-batch, the last of them twice."""
    folder = work_path(t.spark, "landed")
    rows = t.events.withColumn("file", F.pmod(F.xxhash64("event_id"), F.lit(files)).cast("int"))
    again = rows.where(F.col("file") == files - 1).withColumn("file", F.lit(files))
    rows.unionByName(again).repartition("file").write.partitionBy("file").parquet(folder)
    feed = live.file_feed(_session(t), f"{folder}/*", t.events.schema, files_per_batch=1)
    return feed.select(F.col("user_id").cast("string").alias("site_id"), "event_id", F.col("value").alias("occupied"),
                       F.col("ts").cast("timestamp").alias("measured_at"))


_STAMP = "yyyy-MM-dd HH:mm:ss"


@query("stream_ingest", "SELECT CAST(user_id AS VARCHAR) site_id, event_id, event_type, value occupied FROM events")
def stream_ingest(t: Tables):
    path = work_path(t.spark, "ingest")
    _drain(t, live.append_sink(_feed(t), path, ["event_type"]), "ingest")
    return t.spark.read.parquet(path).select("site_id", "event_id", "event_type", "occupied")


@query("stream_latest", """
SELECT site_id, event_id, occupied, strftime(ts, '%Y-%m-%d %H:%M:%S') measured_at FROM (
 SELECT CAST(user_id AS VARCHAR) site_id, event_id, value occupied, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) rn FROM events) WHERE rn = 1
""")
def stream_latest(t: Tables):
    path = work_path(t.spark, "latest")
    rows = live.with_bucket(_feed(t).drop("event_type"), "site_id")
    _drain(t, live.keyed_sink(rows, path, ["bucket", "site_id"], lambda: [F.desc("measured_at"), F.desc("event_id")], ["bucket"]), "latest")
    return t.spark.read.parquet(path).select("site_id", "event_id", "occupied", F.date_format("measured_at", _STAMP).alias("measured_at"))


_LATEST = """
SELECT site_id, event_id, occupied, strftime(ts, '%Y-%m-%d %H:%M:%S') measured_at FROM (
 SELECT CAST(user_id AS VARCHAR) site_id, event_id, value occupied, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) rn FROM events) WHERE rn = 1
"""


@query("stream_latest_state", _LATEST)
def stream_latest_state(t: Tables):
    # from keyed state: what passes is appended, never rewritten
    path = work_path(t.spark, "changes")
    changes = live.newest_changes(_landed(t, 4), ["site_id"], ["measured_at", "event_id"], "7 DAYS")
    _drain(t, live.append_sink(changes, path), "changes")
    newest = t.spark.read.parquet(path).groupBy("site_id").agg(F.max(F.struct("measured_at", "event_id", "occupied")).alias("r"))
    return newest.select("site_id", "r.event_id", "r.occupied", F.date_format("r.measured_at", _STAMP).alias("measured_at"))


@query("stream_dedupe_state", "SELECT CAST(user_id AS VARCHAR) site_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') measured_at FROM events")
def stream_dedupe_state(t: Tables):
    path = work_path(t.spark, "history")
    once = live.unique_readings(_landed(t, 3), ["site_id", "event_id"], "measured_at", ttl="30 DAYS")
    _drain(t, live.append_sink(once, path), "history")
    return t.spark.read.parquet(path).select("site_id", "event_id", F.date_format("measured_at", _STAMP).alias("measured_at"))


@query("stream_dedupe", ctes("live_feed") + "SELECT DISTINCT site_id, event_id, strftime(measured_at, '%Y-%m-%d %H:%M:%S') measured_at FROM live_feed")
def stream_dedupe(t: Tables):
    path = work_path(t.spark, "history")
    feed = _feed(t)
    repeated = feed.select("*", F.explode(F.when(F.col("measured_at") >= "2024-01-16 00:00:00", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
    once = live.unique_readings(repeated.drop("copy"), ["site_id", "measured_at"], "measured_at")
    _drain(t, live.append_sink(once, path), "history")
    return t.spark.read.parquet(path).select("site_id", "event_id", F.date_format("measured_at", _STAMP).alias("measured_at"))


@query("stream_daily", """
SELECT CAST(user_id AS VARCHAR) site_id, strftime(ts, '%Y-%m-%d') AS day, CAST(sum(floor(value)) AS BIGINT) total, count(*) readings FROM events GROUP BY 1, 2
""")
def stream_daily(t: Tables):
    path = work_path(t.spark, "daily")
    daily = live.daily_totals(_feed(t), "site_id", "measured_at", F.floor("occupied"))
    _drain(t, live.keyed_sink(daily, path, ["day", "site_id"], lambda: [F.desc("readings")], ["day"], mode="update"), "daily")
    return t.spark.read.parquet(path).select("site_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "total", "readings")


@query("stream_sweep", """
SELECT event_type dataset_id, CAST(event_id AS VARCHAR) dedup_key, 'neu' stand FROM events WHERE event_type IN ('click', 'view')
UNION ALL SELECT event_type, CAST(event_id AS VARCHAR), 'alt' FROM events WHERE event_type = 'error'
""")
def stream_sweep(t: Tables):
    path = work_path(t.spark, "sweep")
    keyed = lambda df: df.select(
        F.col("event_type").alias("dataset_id"), F.col("event_id").cast("string").alias("dedup_key"), "stand", "fetched")
    # stored: everything of three datasets under old keys that the new snapshot no longer lists
    old = t.events.where("event_type in ('click', 'view', 'error')").withColumn("stand", F.lit("alt")).withColumn("fetched", F.lit(1))
    stale = old.where("event_type <> 'error'").withColumn("event_id", -F.col("event_id") - 1)
    keyed(old.where("event_type = 'error'").unionByName(stale)).write.partitionBy("dataset_id").parquet(path)
    snapshot = keyed(_feed(t).where("event_type in ('click', 'view')").withColumn("stand", F.lit("neu")).withColumn("fetched", F.lit(2)))
    _drain(t, live.keyed_sink(snapshot, path, ["dataset_id", "dedup_key"], lambda: [F.asc("stand")], ["dataset_id"], ["dataset_id"], snapshot="fetched"), "sweep")
    return t.spark.read.parquet(path).select("dataset_id", "dedup_key", "stand")


@query("stream_change_log", """
SELECT 0 batch_id, count(*) rows_loaded, count(DISTINCT user_id) keys_loaded FROM events
""")
def stream_change_log(t: Tables):
    path, log = work_path(t.spark, "latest"), work_path(t.spark, "changes")
    rows = live.with_bucket(_feed(t).drop("event_type"), "site_id")
    _drain(t, live.keyed_sink(rows, path, ["bucket", "site_id"], lambda: [F.desc("measured_at"), F.desc("event_id")], ["bucket"], log=log), "changes")
    return t.spark.read.parquet(log).select("batch_id", "rows_loaded", "keys_loaded")


@query("mart_incremental", """
SELECT CAST(user_id AS VARCHAR) site_id, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, CAST(sum(floor(value)) AS BIGINT) total, count(*) readings,
       CAST(max(floor(value)) AS BIGINT) peak FROM events GROUP BY 1, 2
""")
def mart_incremental(t: Tables):
    # three batches, the last of them once more; each rewrites the buckets it touches
    folder = work_path(t.spark, "marts")
    rows = t.events.select(F.col("user_id").cast("string").alias("site_id"), F.floor("value").alias("v"), F.to_date("ts").alias("day"),
                           "ts", F.pmod(F.xxhash64("user_id"), F.lit(3)).alias("batch"))
    daily = marts.live_marts("site_id", "ts", "v")["daily"]
    for batch in (0, 1, 2, 2):
        marts.refresh(t.spark, folder, daily, rows.where(F.col("batch") == batch), batch)
    return marts.read(t.spark, folder, daily).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("mart_refresh", ctes("live_once") + """
SELECT 'park_ride_latest' mart, count(DISTINCT site_id) n FROM live_once UNION ALL SELECT 'daily', count(DISTINCT (site_id, CAST(measured_at AS DATE))) FROM live_once
""")
def mart_refresh(t: Tables):
    folder = work_path(t.spark, "marts")
    feed = roles.live_feed(t)
    named = {
        "park_ride_latest": feed.groupBy("site_id").agg(F.max_by("occupied", F.struct("measured_at", "event_id")).alias("occupied")),
        "daily": feed.groupBy("site_id", F.to_date("measured_at").alias("day")).agg(F.max("occupied").alias("peak")),
        "statistics_latest": an.statistics_latest(roles.stats_long(t)),
    }
    written = live.refresh_marts(named, folder, {"park_ride_latest", "daily"})
    counted = [t.spark.read.parquet(f"{folder}/{name}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("mart"), "n") for name in written]
    return counted[0].unionByName(counted[1])
