"""Sharding by longest-processing-time scheduling; groups of equal texts stay together.

Groups go, largest first, to the least-loaded shard through a heap. The heap sees a bounded list: a
group larger than 1 / (shards * detail) of all bytes is an item of its own (there are at most
shards * detail of them), and the smaller ones are bundled by a hash of their key into shards * detail
bundles, each an item. So the loads end within about one bundle (1 / detail of a shard) of each other,
whatever the number of groups, unless a single group is larger than a shard's share.

Slots are gapless within a shard: rows are numbered within (shard, bucket), and buckets follow each
other, so no task sorts a whole shard.

Defined cases: a null text counts as empty and has the size of its overhead; equal rows get different
slots; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civicspark.llm.common import body, documents
from civicspark.session import settled

SLOT_BUCKETS = 64


def longest_first(items: list[tuple[str, int]], shards: int) -> dict[str, int]:
    """Items (name, size) to shards: by falling size, ties by name, each to the least-loaded shard."""
    loads = [(0, shard) for shard in range(shards)]
    place = {}
    for name, size in sorted(items, key=lambda item: (-item[1], item[0])):
        load, shard = loads[0]
        place[name] = shard
        heapq.heapreplace(loads, (load + size, shard))
    return place


def assign_shards(
    docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, detail: int = 256,
) -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, shard, slot."""
    raw = body(text_col)
    rows = settled(docs.select(
        F.col(id_col).alias("id"), (F.octet_length(raw) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(raw, 256)).alias("key")), "sized")
    bundles = shards * detail
    bundle = F.concat(F.lit("b"), F.pmod(F.xxhash64("key"), F.lit(bundles)).cast("string"))
    groups = rows.groupBy("key").agg(F.sum("size").alias("size"))
    everything = rows.agg(F.sum("size")).first()[0] or 0
    bound = everything / bundles
    large = groups.where(F.col("size") > bound).select(F.concat(F.lit("g"), F.hex("key")).alias("item"), "size")
    small = groups.where(F.col("size") <= bound).groupBy(bundle.alias("item")).agg(F.sum("size").alias("size"))
    items = [(r["item"], r["size"]) for r in large.unionByName(small).collect()]  # at most 2 * bundles
    place = longest_first(items, shards)
    spark = docs.sparkSession
    table = spark.createDataFrame([(k, s) for k, s in place.items()], "item string, shard int")
    own = table.where(F.col("item").startswith("g")).select(F.unhex(F.substring("item", 2, 64)).alias("key"), F.col("shard").alias("own"))
    shared = table.where(F.col("item").startswith("b")).select(F.col("item").alias("b_item"), F.col("shard").alias("shared"))
    placed = rows.join(F.broadcast(own), "key", "left")  # both tables: at most `bundles` rows
    placed = placed.join(F.broadcast(shared), bundle == F.col("b_item"), "left")
    placed = placed.select("id", "size", "text_crc32", F.coalesce("own", "shared").alias("shard"),
                           F.pmod(F.xxhash64("id", "key"), F.lit(SLOT_BUCKETS)).cast("int").alias("bucket"), "key")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    nth = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("id", "key"))
    numbered = placed.withColumn("nth", nth).join(F.broadcast(starts), ["shard", "bucket"])  # shards * SLOT_BUCKETS rows
    return numbered.select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("start") + F.col("nth") - 1).cast("long").alias("slot"))


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    out = assign_shards(documents(spark, sf_dir), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
