"""Line dedup: range-partitioned line hashes, streamed in order, answered by keep bitmaps.

1. Every text is split at line feeds; a line's key is its text without white space at both ends, A-Z
   lower-cased. Keys of at least ``min_points`` code points become rows of a 128-bit hash, document and
   position; they are written once, since the range boundaries are read from them.
2. The rows are range-partitioned by hash and document, largest document first, and sorted by position
   inside (secondary sort). A task streams its rows: the first document of a key is its keeper, later
   ones lose the line. A key that fills several partitions is cut between documents; the keys at a
   partition's edges are held open and settled by a table of at most two keys per partition.
3. What is dropped returns as one compressed bitmap per document, never as text; the query applies it to
   the texts.

Defined cases: a null or empty text is one empty line; rows with the same id are one document; a null id
is a document that ranks lowest; rows that agree in id and text get the same bitmap; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.llm.common import SPACES, body, documents
from civicspark.session import settled

BLANK = SPACES.encode()
_LINES = "h1 long, h2 long, doc long, raw long, pos int"
_FOUND = "h1 long, h2 long, doc long, raw long, pos int, open boolean, new int"


def line_key(line: bytes) -> bytes:
    return line.strip(BLANK).lower()  # bytes.lower() changes A-Z only


def _points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode("utf-8", "replace"))


def _line_rows(min_points: int):
    def rows(batches):
        for batch in batches:
            out: list[tuple] = []
            docs, raws = batch.column("doc").to_pylist(), batch.column("raw").to_pylist()
            texts = batch.column("t").cast(pa.binary())
            for i in range(len(docs)):
                for pos, line in enumerate(texts[i].as_py().split(b"\n")):
                    key = line_key(line)
                    if len(key) >= min_points and _points(key) >= min_points:
                        out.append((xxhash.xxh3_128_digest(key), docs[i], raws[i], pos))
                if len(out) >= 50_000:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    return rows


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    hashes = np.frombuffer(b"".join(r[0] for r in rows), "<i8").reshape(-1, 2)
    return pa.RecordBatch.from_arrays(
        [pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), pa.array([r[1] for r in rows], pa.int64()),
         pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int32())],
        names=["h1", "h2", "doc", "raw", "pos"])


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_points: int) -> DataFrame:
    t = body(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(t).alias("raw"), t.alias("t")).mapInArrow(
        _line_rows(min_points), _LINES)


class _Stream:
    """Reads keys in order, the documents of a key from the largest down, and emits lines that go.

    Rows wait until their key has ``min_docs`` documents; from then on they are emitted as they come. All
    rows of the partition's first key, and those still waiting at its end, are emitted open. A last key
    that is settled leaves a mark (position -1) with its keeper and its number of documents."""

    def __init__(self, min_docs: int):
        self.min_docs, self.key, self.out = min_docs, None, []

    def row(self, key, doc, raw, pos):
        if key != self.key:
            self.edge = self.key is None
            self.key, self.keeper, self.docs, self.wait = key, doc, 0, []
        new = self.docs == 0 or doc != self.doc
        self.docs, self.doc = self.docs + new, doc
        if self.edge:
            self.out.append((key, doc, raw, pos, True, int(new)))
        elif self.docs < self.min_docs:
            self.wait.append((key, doc, raw, pos, True, int(new)))
        else:
            for k, d, r, p, _, _ in self.wait:
                if d != self.keeper:
                    self.out.append((k, d, r, p, False, 0))
            self.wait = []
            if doc != self.keeper:
                self.out.append((key, doc, raw, pos, False, 0))

    def end(self):
        if self.key is not None and not self.edge:
            if self.docs < self.min_docs:
                self.out += self.wait
            else:
                self.out.append((self.key, self.keeper, 0, -1, True, self.docs))


def _stream(min_docs: int):
    def run(batches):
        state = _Stream(min_docs)
        for batch in batches:
            for h1, h2, doc, raw, pos in zip(*(batch.column(c).to_pylist() for c in ("h1", "h2", "doc", "raw", "pos")), strict=True):
                state.row((h1, h2), doc, raw, pos)
            if state.out:
                yield _found(state.out)
                state.out = []
        state.end()
        if state.out:
            yield _found(state.out)

    return run


def _found(rows: list[tuple]) -> pa.RecordBatch:
    keys = np.array([r[0] for r in rows], np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
         pa.array([r[3] for r in rows], pa.int32()), pa.array([r[4] for r in rows]), pa.array([r[5] for r in rows], pa.int32())],
        names=["h1", "h2", "doc", "raw", "pos", "open", "new"])


def _bitmaps(batches):
    for batch in batches:
        maps = []
        for places in batch.column("places").to_pylist():
            keep = np.ones(max(places) // 8 * 8 + 8, bool)
            keep[places] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("raw"), pa.array(maps, pa.binary())], names=["doc", "raw", "keep"])


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_points: int = 20, min_docs: int = 3) -> DataFrame:
    """doc, raw (hash of the text), keep: a compressed bitmap, 1 for a line that stays. Lines behind its end
    stay, and so do all lines of documents without a bitmap. Lines of keys found in at least ``min_docs``
    documents stay only in the largest id that holds the key."""
    hashes = settled(line_hashes(docs, id_col, text_col, min_points), "line-hashes")
    order = ["h1", "h2", F.col("doc").desc_nulls_last()]
    dealt = hashes.repartitionByRange(*order).sortWithinPartitions(*order, "raw", "pos")
    found = settled(dealt.mapInArrow(_stream(min_docs), _FOUND), "line-stream")
    edges = found.where("open").groupBy("h1", "h2").agg(F.sum("new").alias("docs"), F.max("doc").alias("keeper"))
    edges = edges.where(F.col("docs") >= min_docs)  # two keys a partition at most
    held = found.where("open and pos >= 0").join(F.broadcast(edges), ["h1", "h2"]).where(~F.col("doc").eqNullSafe(F.col("keeper")))
    gone = found.where("not open").select("doc", "raw", "pos").unionByName(held.select("doc", "raw", "pos"))
    return gone.groupBy("doc", "raw").agg(F.collect_set("pos").alias("places")).mapInArrow(_bitmaps, "doc long, raw long, keep binary")


def kept_lines(text: bytes, keep: bytes | None) -> tuple[int, int, bytes]:
    """Number of lines, of dropped lines, and what stays."""
    lines = text.split(b"\n")
    if keep is None:
        return len(lines), 0, text
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[:len(lines)]
    gone = set(np.flatnonzero(bits == 0).tolist())
    return len(lines), len(gone), b"\n".join(line for i, line in enumerate(lines) if i not in gone)


def _apply(with_text: bool):
    def rows(batches):
        for batch in batches:
            texts, keeps = batch.column("t").cast(pa.binary()), batch.column("keep")
            done = [kept_lines(texts[i].as_py(), keeps[i].as_py()) for i in range(len(texts))]
            last = [d[2].decode("utf-8", "replace") for d in done] if with_text else [hashlib.sha256(d[2]).hexdigest() for d in done]
            yield pa.RecordBatch.from_arrays(
                [batch.column("d_doc"), pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()),
                 pa.array(last, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept"])

    return rows


def without_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, **how) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept: the remaining text, or its SHA-256 if not ``with_text``."""
    maps = keep_bitmaps(docs, id_col, text_col, **how)
    t = body(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("d_doc"), F.xxhash64(t).alias("d_raw"), t.alias("t"))
    met = rows.join(maps.hint("shuffle_hash"), F.col("d_doc").eqNullSafe(F.col("doc")) & (F.col("d_raw") == F.col("raw")), "left")
    return met.select("d_doc", "t", "keep").mapInArrow(_apply(with_text), "doc_id long, n_lines long, n_dropped long, kept string")


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    return without_common_lines(documents(spark, sf_dir), with_text=False).withColumnRenamed("kept", "kept_sha256")


SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT rid, doc_id, string_split(t, chr(10)) AS parts FROM d),
l AS (SELECT rid, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM s),
k AS (SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
common AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, common.key IS NOT NULL AND k.doc_id <> common.keeper AS gone FROM k LEFT JOIN common USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid
"""
