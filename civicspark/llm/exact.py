"""Exact duplicates by a tree-merge of sorted digest runs, in DataFrame operations only.

Every partition is a run: its rows are reduced to one row per digest, sorted by digest. Runs then
merge in rounds of ``fan_in``: run ``r`` goes to run ``r // fan_in``, and the rows of one digest meet
in a merging aggregate that keeps the best identifier, until one run is left. A group of copies of
any size is thus one row per partition before the first exchange and at most ``fan_in`` rows in any
later merge. Next to the 256-bit digest, each merge compares the normalised length and a second,
unrelated hash, so rows meet only if all three agree.

Defined cases: a null text counts as empty, empty texts equal each other; rows that agree in id and
text are repeats of one document, of which the first stays; a null id ranks behind all ids; columns
besides id and text are ignored by :func:`duplicate_groups` and kept by :func:`keep_first`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspark.llm.common import body, documents, squeezed
from civicspark.session import settled

KEY = ("digest", "points", "check")


def _marks(text: str) -> list[Column]:
    raw = body(text)
    core = squeezed(raw)
    return [
        F.unhex(F.sha2(core, 256)).alias("digest"), F.length(core).alias("points"), F.xxhash64(core).alias("check"),
        F.length(raw).alias("size"), F.xxhash64(raw).alias("raw"),
    ]


def _best(id_col: str) -> Column:
    """Orders by most code points, then smallest id; min() takes it."""
    return F.struct((-F.col("size")).alias("less"), F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col("raw").alias("raw"))


def _winners(rows: DataFrame, id_col: str, runs: int, fan_in: int) -> DataFrame:
    level = rows.select(
        F.pmod(F.spark_partition_id(), F.lit(runs)).alias("run"), *KEY, _best(id_col).alias("best"), F.col("copies").alias("n"))
    left = runs
    level = level.groupBy("run", *KEY).agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    while left > 1:
        left = -(-left // fan_in)
        level = level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
        level = level.groupBy("run", *KEY).agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    return level.drop("run")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), *_marks(text_col))
    rows = rows.groupBy("id", *KEY, "size", "raw").agg(F.count(F.lit(1)).alias("copies"))
    return settled(rows, "digests")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 512, fan_in: int = 8) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256."""
    rows = _rows(docs, id_col, text_col)
    best = _winners(rows, "id", runs, fan_in)
    out = rows.join(best, list(KEY)).select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("nth"))
    stays = F.col("best.id").eqNullSafe(F.col("id")) & (F.col("best.raw") == F.col("raw")) & (F.col("nth") == 1)
    return out.select(
        F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"),
        stays.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 512, fan_in: int = 8) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Only digests travel through the tree; the
    texts move once, to meet the list of those that stay."""
    best = _winners(_rows(docs, id_col, text_col), "id", runs, fan_in).select(
        F.col("best.id").alias("k_id"), F.col("best.raw").alias("k_raw"))
    packed = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("d_id"), F.xxhash64(body(text_col)).alias("d_raw"))
    met = packed.join(best.hint("shuffle_hash"), F.col("d_id").eqNullSafe(F.col("k_id")) & (F.col("d_raw") == F.col("k_raw")), "left_semi")
    return met.dropDuplicates(["d_id", "d_raw"]).select("doc.*")


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return duplicate_groups(documents(spark, sf_dir))


SQL = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS kept,
       text_sha256
FROM d
"""
