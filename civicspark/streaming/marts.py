"""Marts kept up to date by partial aggregates, and switched to a new version in one step.

A mart stores mergeable partial aggregates in buckets of its keys. A batch is aggregated by itself, merged with the
stored rows of the buckets it touches, and only these buckets are written, into a folder of their own. A
manifest names the folder of every bucket; replacing that one small file is the switch. Readers see
the version before or the one after, never half of one. A batch that comes again (a retried micro-batch) is
recognised by its id and changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.session import settled

MANIFEST = "current.json"


@dataclass(frozen=True)
class Mart:
    """``partial``: name to (aggregate of the input, aggregate that merges two partial results); ``shown``: the columns
    readers get, from keys and partial aggregates. The number of buckets is part of the stored mart."""

    name: str
    keys: tuple[str, ...]
    partial: dict[str, tuple[Column, Callable[[str], Column]]]
    shown: tuple[Column, ...]
    buckets: int = 64

    def partials(self, rows: DataFrame) -> DataFrame:
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        return rows.groupBy(*self.keys).agg(*[a.alias(n) for n, (a, _) in self.partial.items()]).withColumn("bucket", bucket)

    def merged(self, partials: DataFrame) -> DataFrame:
        return partials.groupBy(*self.keys, "bucket").agg(*[merge(n).alias(n) for n, (_, merge) in self.partial.items()])


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, folder: str, name: str) -> dict:
    """The current version: id of the last batch, schema of the partial aggregates, folder of every bucket."""
    path = f"{folder}/{name}/{MANIFEST}"
    _, target, fs = _hadoop(spark, path)
    if not fs.exists(target):
        return {"batch": None, "schema": None, "buckets": {}}
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def _switch(spark: SparkSession, folder: str, name: str, version: dict) -> None:
    """Write the manifest beside the current one, then rename it over that: one atomic step of the file system."""
    jvm, target, fs = _hadoop(spark, f"{folder}/{name}/{MANIFEST}")
    _, fresh, _ = _hadoop(spark, f"{folder}/{name}/{MANIFEST}-{uuid.uuid4().hex}")
    out = fs.create(fresh)
    out.write(bytearray(json.dumps(version).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    modes = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    modes[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fresh, target, modes)


def refresh(spark: SparkSession, folder: str, mart: Mart, batch: DataFrame, batch_id: int | None = None) -> int:
    """Bring one batch into the mart; returns the number of buckets written. Ids of batches rise."""
    before = manifest(spark, folder, mart.name)
    if batch_id is not None and before["batch"] is not None and batch_id <= before["batch"]:
        return 0
    fresh = settled(mart.partials(batch), "mart-batch")
    touched = sorted(r["bucket"] for r in fresh.select("bucket").distinct().collect())  # as many as buckets at most
    version, buckets = uuid.uuid4().hex, dict(before["buckets"])
    if touched:
        held = [buckets[str(b)] for b in touched if str(b) in buckets]
        if held:
            stored = spark.read.schema(before["schema"]).parquet(*[f"{folder}/{mart.name}/{p}" for p in held])
            bucket = F.pmod(F.xxhash64(*mart.keys), F.lit(mart.buckets)).cast("int")
            fresh = fresh.unionByName(stored.withColumn("bucket", bucket))
        mart.merged(fresh).repartition("bucket").write.partitionBy("bucket").parquet(f"{folder}/{mart.name}/{version}")
        buckets.update({str(b): f"{version}/bucket={b}" for b in touched})
    ids = [i for i in (before["batch"], batch_id) if i is not None]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fresh.schema if f.name != "bucket")
    _switch(spark, folder, mart.name, {"batch": max(ids) if ids else None, "schema": schema, "buckets": buckets})
    return len(touched)


def rebuild(spark: SparkSession, folder: str, mart: Mart, rows: DataFrame) -> None:
    """The whole mart anew, as one version."""
    version = uuid.uuid4().hex
    whole = mart.partials(rows)
    whole.repartition("bucket").write.partitionBy("bucket").parquet(f"{folder}/{mart.name}/{version}")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.schema if f.name != "bucket")
    _, root, fs = _hadoop(spark, f"{folder}/{mart.name}/{version}")
    found = [f.getPath().getName() for f in fs.listStatus(root) if f.isDirectory()]
    buckets = {n.split("=")[1]: f"{version}/{n}" for n in found if n.startswith("bucket=")}
    _switch(spark, folder, mart.name, {"batch": manifest(spark, folder, mart.name)["batch"], "schema": schema, "buckets": buckets})


def read(spark: SparkSession, folder: str, mart: Mart) -> DataFrame:
    """The current version."""
    now = manifest(spark, folder, mart.name)
    if not now["schema"]:
        raise ValueError(f"{mart.name} has no version yet")
    paths = [f"{folder}/{mart.name}/{p}" for p in now["buckets"].values()]
    rows = spark.read.schema(now["schema"]).parquet(*paths) if paths else spark.createDataFrame([], now["schema"])
    return rows.select(*mart.shown)


def discard(spark: SparkSession, folder: str, name: str) -> int:
    """Delete versions the manifest no longer names; to be run when no reader of an older version is left."""
    used = {p.split("/")[0] for p in manifest(spark, folder, name)["buckets"].values()}
    _, root, fs = _hadoop(spark, f"{folder}/{name}")
    old = [f.getPath() for f in fs.listStatus(root) if f.isDirectory() and f.getPath().getName() not in used]
    return sum(bool(fs.delete(p, True)) for p in old)


def live_marts(site: str, ts: str, value: str) -> dict[str, Mart]:
    """The marts that follow a live feed: the newest reading of a site, and its days."""
    newest = F.max(F.struct(F.col(ts), F.col(value)))
    return {
        "latest": Mart("latest", (site,), {"newest": (newest, F.max), "readings": (F.count(F.lit(1)), F.sum)},
                       (F.col(site), F.col(f"newest.{ts}").alias(ts), F.col(f"newest.{value}").alias(value), F.col("readings"))),
        "daily": Mart("daily", (site, "day"), {"total": (F.sum(value), F.sum), "readings": (F.count(F.lit(1)), F.sum), "peak": (F.max(value), F.max)},
                      (F.col(site), F.col("day"), F.col("total"), F.col("readings"), F.col("peak"))),
    }
