"""Hard-negative mining by coordinate pruning over length buckets.

1. Rows are range-partitioned by label and falling length into cells of a few thousand rows, written once
   with the number of their cell.
2. Anchors meet cells as two sides of a cogroup (anchors in blocks, so neither side of a group grows
   with the data). Inside a cell, rows of similar length form buckets; a bucket keeps, for every
   coordinate of its unit vectors, the sorted list of values.
3. An anchor asks a bucket for rows whose product may reach its threshold, the k-th best so far. With the
   largest length of the bucket that is a bound on the cosine, hence an angle, hence a range of feasible
   values in each coordinate. The ranges of the anchor's ``FOCUS`` largest coordinates are looked up in the
   sorted lists, the shortest list is taken and cut down by the other ranges; what is left is
   multiplied out exactly. Buckets too short for the threshold end the search.
4. First round: the best rows of the anchor's label, from the cells that hold the label. Second round: for each
   positive the best rows of other labels whose score lies in the band, from the cells whose longest row
   can reach the lowest band. Windows pick the best of all cells.

Products are integers: by floating point where all of them stay below 2^53, else by 64-bit integers.

Defined cases: rows with a null id, label or vector take no part; of rows with the same id the one with the smallest
label, then vector counts; vectors of unequal length are filled up with zeros; a positive whose score is
negative has an empty band, one whose score is zero takes rows of score zero; an anchor
without positives, or a positive without negatives, gives no rows; ties go to the smaller id; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicspark.session import settled

CELL, BUCKET, BLOCK, FOCUS = 4096, 256, 512, 4
SLACK = 1e-9  # for rounding of cosines


def matrix(column) -> np.ndarray:
    """Lists of integers as rows, filled up with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), int(sizes.max()) if len(sizes) else 0), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Bucket:
    """Rows of similar length with the sorted lists of their unit coordinates."""

    def __init__(self, vectors: np.ndarray, lengths: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        self.vectors, self.ids, self.labels = vectors, ids, labels
        self.longest = float(lengths.max())
        self.unit = vectors / np.maximum(lengths, 1e-300)[:, None]
        self.order = np.argsort(self.unit, axis=0)
        self.sorted = np.take_along_axis(self.unit, self.order, axis=0)
        self.every = np.arange(len(ids))

    def reach(self, anchor: Anchor, threshold: float) -> np.ndarray:
        """Rows whose product with the anchor may be ``threshold`` or more."""
        if threshold <= 0 or not len(anchor.focus):
            return self.every
        most = anchor.length * self.longest
        if most * (1 + SLACK) < threshold:
            return self.every[:0]
        wide = np.arccos(min(1.0, threshold / most))
        low = np.cos(np.minimum(np.pi, anchor.angles + wide)) - SLACK
        high = np.cos(np.maximum(0.0, anchor.angles - wide)) + SLACK
        spans = [(np.searchsorted(self.sorted[:, f], a, "left"), np.searchsorted(self.sorted[:, f], b, "right"))
                 for f, a, b in zip(anchor.focus, low, high, strict=True)]
        least = min(range(len(spans)), key=lambda i: spans[i][1] - spans[i][0])
        rows = self.order[spans[least][0]:spans[least][1], anchor.focus[least]]
        for i, f in enumerate(anchor.focus):
            if i != least and len(rows):
                values = self.unit[rows, f]
                rows = rows[(values >= low[i]) & (values <= high[i])]
        return rows


class Anchor:
    def __init__(self, vector: np.ndarray, focus: int = FOCUS):
        self.vector, self.length = vector, float(np.sqrt((vector.astype(np.float64) ** 2).sum()))
        unit = vector / max(self.length, 1e-300)
        self.focus = np.argsort(-np.abs(unit), kind="stable")[:focus] if self.length else np.zeros(0, np.int64)
        self.angles = np.arccos(np.clip(unit[self.focus], -1, 1))


def _buckets(rows: pa.Table, width: int) -> tuple[list[Bucket], np.ndarray]:
    vectors = matrix(rows.column("v"))
    vectors = np.pad(vectors, ((0, 0), (0, max(0, width - vectors.shape[1]))))
    lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
    ids, labels = rows.column("id").to_numpy(), rows.column("label").to_numpy()
    order = np.lexsort((ids, -lengths))
    cut = [order[i:i + BUCKET] for i in range(0, len(order), BUCKET)]
    return [Bucket(vectors[c], lengths[c], ids[c], labels[c]) for c in cut], vectors


def _anchors(table: pa.Table, rows: pa.Table):
    """Buckets and anchors of one width, in a number type in which all products are exact."""
    asked = matrix(table.column("a_v"))
    buckets, vectors = _buckets(rows, asked.shape[1])
    width = vectors.shape[1]
    asked = np.pad(asked, ((0, 0), (0, width - asked.shape[1])))
    if width * float(np.abs(vectors).max(initial=0)) * float(np.abs(asked).max(initial=0)) < 2**53:
        for b in buckets:
            b.vectors = b.vectors.astype(np.float64)
        asked = asked.astype(np.float64)
    return buckets, [Anchor(v) for v in asked]


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


NONE = np.zeros(0, np.int64)
_NEAR = "a_id long, id long, score long"


def _positives(k: int):
    """The k best rows of the anchor's label in one cell."""

    def search(key: tuple[pa.Scalar, ...], rows: pa.Table, probes: pa.Table) -> pa.Table:
        out = [(NONE, NONE)] * probes.num_rows
        a_ids, a_labels = probes.column("a_id").to_numpy(), probes.column("a_label").to_numpy()
        if rows.num_rows and probes.num_rows:
            buckets, anchors = _anchors(probes, rows)
            for i, anchor in enumerate(anchors):
                top = (NONE, NONE)
                for b in buckets:
                    at = b.reach(anchor, top[0][-1] if len(top[0]) == k else -np.inf)
                    at = at[(b.labels[at] == a_labels[i]) & (b.ids[at] != a_ids[i])]
                    if len(at):
                        scores = (b.vectors[at] @ anchor.vector).astype(np.int64)
                        top = best(np.concatenate([top[0], scores]), np.concatenate([top[1], b.ids[at]]), k)
                out[i] = top
        return pa.table({"a_id": np.repeat(a_ids, [len(t[0]) for t in out]), "id": np.concatenate([NONE, *[t[1] for t in out]]),
                         "score": np.concatenate([NONE, *[t[0] for t in out]])})

    return search


_FOUND = "a_id long, p_id long, p_score long, id long, score long"


def _negatives(k: int, low: int, high: int):
    """For each positive the k best rows of other labels in one cell with ``low`` to ``high`` percent of its score."""

    def search(key: tuple[pa.Scalar, ...], rows: pa.Table, probes: pa.Table) -> pa.Table:
        a, p, ps, ids, scores = [], [], [], [], []
        if rows.num_rows and probes.num_rows:
            buckets, anchors = _anchors(probes, rows)
            a_ids, a_labels = probes.column("a_id").to_numpy(), probes.column("a_label").to_numpy()
            positives = probes.column("positives").to_pylist()
            for i, anchor in enumerate(anchors):
                asked = [(x["id"], x["score"]) for x in positives[i]]
                tops = [(NONE, NONE)] * len(asked)
                least = [-(-low * s // 100) for _, s in asked]
                for b in buckets:
                    need = min(t[0][-1] if len(t[0]) == k else m for t, m in zip(tops, least, strict=True))
                    at = b.reach(anchor, need)
                    at = at[b.labels[at] != a_labels[i]]
                    if not len(at):
                        continue
                    got = (b.vectors[at] @ anchor.vector).astype(np.int64)
                    for j, (_, s) in enumerate(asked):
                        held = (100 * got >= low * s) & (100 * got <= high * s)
                        if len(tops[j][0]) == k:
                            held &= got >= tops[j][0][-1]
                        if held.any():
                            tops[j] = best(np.concatenate([tops[j][0], got[held]]), np.concatenate([tops[j][1], b.ids[at[held]]]), k)
                for (p_id, s), top in zip(asked, tops, strict=True):
                    n = len(top[0])
                    a += [a_ids[i]] * n
                    p += [p_id] * n
                    ps += [s] * n
                    ids.append(top[1])
                    scores.append(top[0])
        return pa.table({"a_id": pa.array(a, pa.int64()), "p_id": pa.array(p, pa.int64()), "p_score": pa.array(ps, pa.int64()),
                         "id": np.concatenate([NONE, *ids]), "score": np.concatenate([NONE, *scores])})

    return search


def in_cells(rows: DataFrame) -> DataFrame:
    """id, label, v, length and the cell: rows of neighbouring length under one label."""
    one = rows.where("id is not null and label is not null and v is not null").groupBy("id").agg(F.min(F.struct("label", "v")).alias("r"))
    squares = F.aggregate("r.v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    one = settled(one.select("id", F.col("r.label").alias("label"), F.col("r.v").alias("v"), F.sqrt(squares).alias("length")), "vectors")
    cells = max(1, -(-one.count() // CELL))
    dealt = one.repartitionByRange(cells, "label", F.desc("length"), F.xxhash64("id"))
    return settled(dealt.withColumn("cell", F.spark_partition_id()), "cells")


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: id long, label int or long, v array<long>; ``is_anchor`` is a condition on them."""
    cells = in_cells(rows.select("id", F.col("label").cast("long").alias("label"), "v"))
    anchors = cells.where(is_anchor).select(F.col("id").alias("a_id"), F.col("label").alias("a_label"), F.col("v").alias("a_v"), F.col("length").alias("a_length"))
    blocks = max(1, -(-anchors.count() // BLOCK))
    block = F.pmod(F.xxhash64("a_id"), F.lit(blocks)).cast("int")
    copies = cells.select("cell", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "id", "label", "v")

    held = settled(cells.groupBy("cell", "label").agg(F.max("length").alias("longest")), "cell-labels")
    first = anchors.join(held, F.col("a_label") == F.col("label")).select("cell", block.alias("block"), "a_id", "a_label", "a_v")
    near = copies.groupBy("cell", "block").cogroup(first.groupBy("cell", "block")).applyInArrow(_positives(positives), _NEAR)
    order = Window.partitionBy("a_id").orderBy(F.desc("score"), "id")
    near = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= positives)
    asked = settled(near.groupBy("a_id").agg(F.collect_list(F.struct("id", "score")).alias("positives")), "positives").withColumnRenamed("a_id", "p")

    longest = held.groupBy("cell").agg(F.max("longest").alias("longest"))
    least = F.array_min(F.transform("positives", lambda x: x["score"])) * low / 100
    last = held.agg(F.max("cell").alias("m")).first()["m"] or 0
    second = anchors.join(asked, F.col("a_id") == F.col("p")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(last))))
    second = second.join(longest, F.col("c") == F.col("cell")).where(F.col("a_length") * F.col("longest") * (1 + 1e-9) >= least)
    second = second.select("cell", block.alias("block"), "a_id", "a_label", "a_v", "positives")
    found = copies.groupBy("cell", "block").cogroup(second.groupBy("cell", "block")).applyInArrow(_negatives(negatives, low, high), _FOUND)
    order = Window.partitionBy("a_id", "p_id").orderBy(F.desc("score"), "id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return found.select(F.col("a_id").alias("anchor_id"), F.col("p_id").alias("positive_id"), "rank", F.col("id").alias("negative_id"),
                        F.col("p_score").alias("positive_score"), F.col("score").alias("negative_score"))


def integer_rows(table: DataFrame) -> DataFrame:
    """id, label, v of the table of embeddings: components as floor(256 * x), every seventh row under the next label;
    rows with a null or a component that is null or not finite take no part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    whole = table.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(~bad)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return whole.select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"),
                        F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("long")).alias("v"))


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{str(sf_dir).rstrip('/')}/embeddings.parquet")
    return hard_negatives(integer_rows(table), F.col("id") % 100 == 0)


SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same,
             list_sum(list_transform(list_zip(a.v, r.v), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0)))::BIGINT AS score
      FROM e a JOIN e r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
