"""Live feeds as Structured Streaming jobs.

Targets are Parquet folders partitioned by part of their key. A micro-batch rewrites only partitions
it touches, and running a batch again gives the same result, so lost executors and restarted queries
are harmless. Checkpoints belong in the shared folder the cluster names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StreamingQuery

from civicspark.operators import state as st

LIVE_INTERVAL = "5 minutes"  # fixed value: polling interval of live feeds


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_session(spark: SparkSession, state_partitions: int | None = None) -> SparkSession:
    """A session for streams on the same cluster: keyed state in the RocksDB store, and its own number of state
    partitions, which is fixed for the life of a checkpoint. Other queries keep their settings."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # state with processing time asks for another batch without end, so a drained stream would never stop
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    if state_partitions:
        own.conf.set("spark.sql.shuffle.partitions", str(state_partitions))
    return own


def file_feed(spark: SparkSession, folder: str, schema, fmt: str = "parquet", glob: str | None = None,
              files_per_batch: int | None = None) -> DataFrame:
    """Landed feed files as a stream."""
    reader = spark.readStream.format(fmt).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def start(writer: DataStreamWriter, checkpoint: str, once: bool = False, every: str = LIVE_INTERVAL) -> StreamingQuery:
    """Start on the live interval, or drain what is there and stop."""
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


# --- keyed state -------------------------------------------------------------------------------------------

class _Newest(StatefulProcessor):
    """Keeps the newest row of a key and passes it on when it changes."""

    def __init__(self, schema: str, order: list[str], ttl: int | None):
        self.schema, self.order, self.ttl = schema, order, ttl

    def init(self, handle) -> None:
        self.held = handle.getValueState("newest", self.schema, self.ttl)

    def _rank(self, row):
        return [(row[c] is not None, row[c]) if row[c] is not None else (False,) for c in self.order]

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        found = max((r.asDict() for r in rows), key=self._rank)
        if self.held.exists():
            names = list(found)
            kept = dict(zip(names, self.held.get(), strict=True))
            if self._rank(kept) >= self._rank(found):
                self.held.update(tuple(kept.values()))  # seen again: the expiry starts anew
                return
        self.held.update(tuple(found.values()))
        yield Row(**found)

    def close(self) -> None:
        pass


def _millis(ttl: str | None) -> int | None:
    return None if ttl is None else int(SparkSession.active().sql(f"SELECT unix_millis(timestamp '1970-01-01 00:00:00Z' + INTERVAL {ttl}) AS m").first()["m"])


def newest_changes(stream: DataFrame, keys: list[str], order: list[str], ttl: str | None = None) -> DataFrame:
    """Every change of the newest row per key, from keyed state: a row passes when it is ahead of all before it in the
    columns ``order``, so late rows and repeats write nothing. The newest rows of what passed are the
    newest of the whole feed. A key that is not heard of for ``ttl`` (processing time) is forgotten, which
    bounds the state by the live keys. Needs a stream of :func:`stream_session`."""
    return _with_state(stream, keys, lambda schema: _Newest(schema, order, _millis(ttl)), ttl)


def _with_state(stream: DataFrame, keys: list[str], processor, ttl: str | None) -> DataFrame:
    """Moments pass through the state as microseconds, whatever the time zone of a worker."""
    moments = [f.name for f in stream.schema if f.dataType.simpleString() == "timestamp"]
    plain = stream.withColumns({c: F.unix_micros(c) for c in moments})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    out = plain.groupBy(*keys).transformWithState(processor(schema), schema, "Append", "ProcessingTime" if ttl else "None")
    return out.withColumns({c: F.timestamp_micros(c) for c in moments})


def _first_of_keys(stream: DataFrame, keys: list[str], ttl: int) -> DataFrame:
    """The first row of every key, by Spark's own deduplication: no row and no call to the state goes through Python.

    Processing time is cut into spans of ``ttl`` milliseconds. A row claims its key for the span it comes in and
    for the next one; the first claim of a key and span wins. A row passes if it wins the span it comes in, so a key
    that was claimed ahead stays out and, by its repeats, claims the next span again."""
    span = F.floor(F.unix_millis("_arrived") / ttl)  # the time of a batch, the same when a batch is repeated
    claims = stream.withColumn("_arrived", F.current_timestamp()).withColumn(
        "_ahead", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_span", span + F.col("_ahead"))
    won = claims.withWatermark("_arrived", f"{2 * ttl} milliseconds").dropDuplicatesWithinWatermark([*keys, "_span"])
    return won.where("_ahead = 0").drop("_arrived", "_ahead", "_span")


def append_sink(stream: DataFrame, path: str, parts: list[str] | None = None) -> DataStreamWriter:
    """Plain append with the exactly-once file sink."""
    writer = stream.writeStream.format("parquet").option("path", path).outputMode("append")
    return writer.partitionBy(*parts) if parts else writer


def with_bucket(df: DataFrame, key: str, buckets: int = 16) -> DataFrame:
    """Partition column derived from the key, for targets without a natural one."""
    return df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def keyed_sink(stream: DataFrame, path: str, keys: list[str], order: Callable[[], list[Column]], parts: list[str],
               snapshot_scope: list[str] | None = None, log: str | None = None, mode: str = "append",
               snapshot: str | None = None) -> DataStreamWriter:
    """Upsert every micro-batch into a keyed folder; ``order`` decides between stored and new rows, so late
    rows do not replace newer ones.

    With a scope, rows that a newer snapshot lost are swept. ``snapshot`` names the column with the snapshot's
    ascending id (its fetch time), which the table keeps: a snapshot may span micro-batches, its first rows
    retire older ones and its later rows join the first. While it is still arriving, readers see its part.
    An empty batch changes nothing. With ``log`` the counts of each batch are kept per batch id."""
    if snapshot_scope and not (snapshot and set(parts) <= set(snapshot_scope)):
        raise ValueError("a snapshot needs the column of its id, and partitions that hold whole scopes")

    def load(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            if batch.isEmpty():
                return
            if snapshot_scope:
                rank = [F.desc_nulls_last(snapshot), *order()]
                merge = lambda old, new: st.merge_snapshot(old, new, snapshot_scope, keys, order(), snapshot)
                # a batch may hold the end of one snapshot and the start of the next
                fresh = st.merge_snapshot(batch.limit(0), batch, snapshot_scope, keys, order(), snapshot)
            else:
                rank, fresh = order(), batch
                merge = lambda old, new: st.merge_newest(old, new, keys, order())
            st.upsert_path(spark, path, fresh, keys, rank, parts, None, merge)
            if log:
                counts = batch.agg(F.count(F.lit(1)).alias("rows_loaded"), F.count_distinct(*keys).alias("keys_loaded"))
                counts.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
                    "partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(log)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(load).outputMode(mode)


def unique_readings(stream: DataFrame, keys: list[str], ts: str, delay: str | None = None, ttl: str | None = None) -> DataFrame:
    """Each reading once, although the feed repeats its window. All keys are remembered, so a row of any
    age counts. ``ttl`` forgets keys the feed has not repeated for that time (processing time; at the latest after twice
    that time), which bounds the state by the window of the feed and drops no late row. A ``delay`` bounds it by event time
    where older rows cannot come, and drops them if they do."""
    timed = stream.where(F.col(ts).isNotNull())
    if ttl:
        return _first_of_keys(timed, keys, _millis(ttl))
    return timed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys) if delay else timed.dropDuplicates(keys)


def daily_totals(stream: DataFrame, key: str, ts: str, value: Column, delay: str | None = None) -> DataFrame:
    """Running daily totals per key. Emitted in update mode, so a day shows up before it closes; late
    readings count, whatever their age. The state is a row per key and day; a ``delay`` bounds it where
    older rows cannot come, and drops them if they do."""
    return (
        (stream.withWatermark(ts, delay) if delay else stream)
        .groupBy(F.window(ts, "1 day"), key)
        .agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("readings"))
        .select(key, F.to_date("window.start").alias("day"), "total", "readings"))


def refresh_marts(marts: dict[str, DataFrame], folder: str, live: set[str] | None = None) -> list[str]:
    """Rewrite mart folders, all of them or the live subset; returns the names written."""
    chosen = [name for name in marts if live is None or name in live]
    for name in chosen:
        marts[name].write.mode("overwrite").parquet(f"{folder}/{name}")
    return chosen
