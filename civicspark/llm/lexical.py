"""Ranked lexical search by the Best Position Algorithm.

Every task cuts its documents into shards of bounded size and builds, for the terms that are asked for,
impact lists of a shard: the documents of a term by falling impact. An item reads its lists in parallel
(sorted access); each new document is looked up in all other lists (direct access), which gives its
whole score and marks its places there as seen. The best position of a list is the end of its unbroken run
of seen places, which is never behind the last place read and mostly ahead of it, so the sum of the impacts
at the best positions is a tighter bound on every document not yet met than the sum at the last places
read. A shard ends when that bound lies strictly below the k-th score found so far by the task, so ties are
complete. Tasks return k rows an item; a window picks the k of all.

Collection statistics (documents with terms, all their terms, documents of a term) come from one pass over
all documents. Items travel to the tasks in blocks of at most ``block_terms`` distinct terms an item summed
up (a longer item is a block of its own); every block is held against all documents.

Weights: w = floor(1000 * ln((2N + 2) / (2df + 1))); m = 100 - 90 + (90 * n * N) div L; a term adds
w * ((10^9 * tf) div (1000 * tf + 8 * m)), all in 64-bit integers.

Defined cases: a null or empty text has no terms; an item without terms, or whose terms no document holds,
returns nothing; every row of documents and of items counts by itself, so repeated rows are ranked beside
each other; a null doc_id comes behind its ties; without documents the result is empty; extra columns
are ignored. Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civicspark.llm.common import _IS_ALNUM, U64, body, documents, hashed_words, slices, text_buffers
from civicspark.session import settled

CHUNK = 1 << 20
SHARD_DOCS, SHARD_POSTINGS = 1 << 14, 1 << 21
BLOCK_TERMS = 1 << 18
NO_ID = np.iinfo(np.int64).max
_TOP = "q int, doc_id long, score long"


def _item_terms(batches):
    for batch in batches:
        data, offsets = text_buffers(batch.column("t"))
        hashes, rows = hashed_words(data, offsets, _IS_ALNUM)
        cuts = np.searchsorted(rows, np.arange(len(offsets)))
        own = [np.unique(hashes[a:b]).view(np.int64) for a, b in zip(cuts, cuts[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array([o.tolist() for o in own], pa.list_(pa.int64()))], names=["item_id", "terms"])


def blocks_of(items: DataFrame, block_terms: int) -> Iterator[list]:
    """Items (item_id, terms) in blocks of a bounded number of terms."""
    block, size = [], 0
    for row in items.toLocalIterator(prefetchPartitions=False):
        if block and size + len(row["terms"]) > block_terms:
            yield block
            block, size = [], 0
        block.append(row)
        size += len(row["terms"])
    if block:
        yield block


class Postings:
    """Counts of the wanted terms in the texts of a batch."""

    def __init__(self, wanted: np.ndarray, data: np.ndarray, offsets: np.ndarray):
        hashes, rows = hashed_words(data, offsets, _IS_ALNUM)
        self.length = np.bincount(rows, minlength=len(offsets) - 1).astype(np.int64)
        place = np.searchsorted(wanted, hashes)
        hit = wanted[np.minimum(place, len(wanted) - 1)] == hashes if len(wanted) else np.zeros(len(hashes), bool)
        key, self.tf = np.unique(rows[hit] * len(wanted) + place[hit], return_counts=True)
        self.doc, self.term = np.divmod(key, max(len(wanted), 1))


def _statistics(wanted: np.ndarray):
    """(term, n): documents of each wanted term; -1 the documents with terms, -2 all their terms."""

    def rows(batches):
        df, docs, total = np.zeros(len(wanted), np.int64), 0, 0
        for batch in batches:
            data, offsets = text_buffers(batch.column("t"))
            for lo, hi in slices(offsets, CHUNK):
                p = Postings(wanted, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                df += np.bincount(p.term, minlength=len(wanted))
                docs += int((p.length > 0).sum())
                total += int(p.length.sum())
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, [-1, -2]), pa.int64()), pa.array(np.append(df[found], [docs, total]), pa.int64())], names=["term", "n"])

    return rows


class Shard:
    """Impact lists of one set of documents, for sorted and for direct access."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, ids: np.ndarray, terms: int):
        self.ids, self.docs = ids, len(ids)
        order = np.lexsort((doc, term))
        term, doc, impact = term[order], doc[order], impact[order]
        self.starts = np.searchsorted(term, np.arange(terms + 1))
        self.keys, self.impact = term * self.docs + doc, impact  # by term and document
        ranked = np.lexsort((doc, -impact, term))
        self.read_doc, self.read_impact = doc[ranked], impact[ranked]  # by term and falling impact
        self.place = np.empty(len(ranked), np.int64)
        self.place[ranked] = np.arange(len(ranked))

    def search(self, terms: np.ndarray, top: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of ``top`` (scores, ids) and of this shard."""
        lo, hi = self.starts[terms], self.starts[terms + 1]
        terms, lo, hi = terms[hi > lo], lo[hi > lo], hi[hi > lo]
        met = np.zeros(self.docs, bool)
        seen = [np.zeros(b - a, bool) for a, b in zip(lo, hi, strict=True)]
        best = np.zeros(len(terms), np.int64)  # seen places from the start
        depth, step = 0, 16
        while len(terms):
            parts = [self.read_doc[a + depth:min(a + depth + step, b)] for a, b in zip(lo, hi, strict=True)]
            for s in seen:
                s[depth:depth + step] = True
            fresh = np.concatenate(parts)
            fresh = np.unique(fresh[~met[fresh]])
            met[fresh] = True
            want = (terms[:, None] * self.docs + fresh).ravel()  # direct access to all lists
            at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            found = (self.keys[at] == want).reshape(len(terms), -1)
            at = at.reshape(len(terms), -1)
            score = np.where(found, self.impact[at], 0).sum(axis=0)
            for i, s in enumerate(seen):
                s[self.place[at[i][found[i]]] - lo[i]] = True
            some = score > 0
            top = _first(np.concatenate([top[0], score[some]]), np.concatenate([top[1], self.ids[fresh[some]]]), k)
            depth, step = depth + step, min(step * 2, 1024)
            bound = 0
            for i, s in enumerate(seen):
                rest = s[best[i]:]
                best[i] += len(rest) if rest.all() else int(rest.argmin())
                if best[i] < len(s):
                    bound += int(self.read_impact[lo[i] + best[i] - 1])
            if all(best[i] == len(s) for i, s in enumerate(seen)) or (len(top[0]) == k and bound < top[0][-1]):
                break
        return top


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _search(wanted: np.ndarray, items: list[np.ndarray], weights: np.ndarray, docs: int, total: int, k: int):
    """The k best documents of a task for every item (places of its terms in ``wanted``)."""

    def rows(batches):
        none = np.zeros(0, np.int64)
        tops = [(none, none) for _ in items]
        held: list[tuple] = []
        size = count = 0

        def close():
            nonlocal held, size, count
            if size:
                term, doc, impact, ids = (np.concatenate([h[i] for h in held]) for i in range(4))
                shard = Shard(term, doc, impact, ids, len(wanted))
                for q, terms in enumerate(items):
                    tops[q] = shard.search(terms, tops[q], k)
            held, size, count = [], 0, 0

        for batch in batches:
            data, offsets = text_buffers(batch.column("t"))
            ids = batch.column("doc_id").fill_null(NO_ID).to_numpy()
            for lo, hi in slices(offsets, CHUNK):
                p = Postings(wanted, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                m = 100 - 90 + 90 * p.length * docs // max(total, 1)
                impact = weights[p.term] * (1_000_000_000 * p.tf // (1000 * p.tf + 8 * m[p.doc]))
                held.append((p.term, p.doc + count, impact, ids[lo:hi]))
                size, count = size + len(p.tf), count + hi - lo
                if count >= SHARD_DOCS or size >= SHARD_POSTINGS:
                    close()
        close()
        q = np.repeat(np.arange(len(items)), [len(t[0]) for t in tops])
        score, ids = (np.concatenate([t[i] for t in tops]) if tops else none for i in range(2))
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(score, pa.int64())], names=["q", "doc_id", "score"])

    return rows


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of every item, with scores above 0."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).alias("t"))
    asked = items.select(F.col(item_col).alias("item_id"), body(item_text).alias("t"))
    kind = asked.schema["item_id"].dataType
    asked = settled(asked.mapInArrow(_item_terms, f"item_id {kind.simpleString()}, terms array<long>"), "items")
    found = []
    for block in blocks_of(asked, block_terms):
        wanted = np.unique(np.array([t for row in block for t in row["terms"]], np.int64).view(U64))
        counts = {r["term"]: r["n"] for r in texts.select("t").mapInArrow(_statistics(wanted), "term long, n long").groupBy("term").agg(
            F.sum("n").alias("n")).collect()}  # a row per wanted term
        n, total = counts.get(-1, 0), counts.get(-2, 0)
        weights = np.array([weight(n, counts.get(i, 0)) for i in range(len(wanted))], np.int64)
        places = [np.searchsorted(wanted, np.array(row["terms"], np.int64).view(U64)) for row in block]
        places = [p[weights[p] > 0] for p in places]
        names = spark.createDataFrame([(q, row["item_id"]) for q, row in enumerate(block)], asked.select(F.lit(0).alias("i"), "item_id").schema)
        tops = texts.mapInArrow(_search(wanted, places, weights, n, total, k), _TOP)
        order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = tops.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found.append(best.join(names, F.col("q") == F.col("i")).select("item_id", "rank", "doc_id", "score"))
    if not found:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionAll, found)


def op12_ranked_search(spark, sf_dir: str) -> DataFrame:
    return ranked(documents(spark, sf_dir), spark.read.parquet(f"{str(sf_dir).rstrip('/')}/benchmark.parquet"))


SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
                  regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents WHERE text IS NOT NULL),
i AS (SELECT row_number() OVER () AS iid, item_id,
             unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))) AS t FROM benchmark WHERE text IS NOT NULL),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ts))::BIGINT AS total FROM d WHERE len(ts) > 0),
p AS (SELECT rid, any_value(doc_id) AS doc_id, any_value(n) AS n, t, count(*) AS tf
      FROM (SELECT rid, doc_id, len(ts) AS n, unnest(ts) AS t FROM d) GROUP BY rid, t),
w AS (SELECT t, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY t, n_docs),
f AS (SELECT rid, doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // total))) AS impact
      FROM p JOIN w USING (t), s),
r AS (SELECT iid, item_id, rid, any_value(doc_id) AS doc_id, sum(impact)::BIGINT AS score FROM i JOIN f USING (t) GROUP BY iid, item_id, rid)
SELECT item_id, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
FROM r WHERE score > 0
QUALIFY rank <= 10
"""
