"""Substring dedup by hashing units of text.

1. Every text is cut into units (lines, paragraphs, or segments: lines cut again behind sentence ends, so
   that a passage inside a line is found too). A unit is normalised to its lower-cased words; neighbouring
   units of fewer than ``min_unit_words`` words are glued until they have as many. What stays shorter
   between two longer units is not hashed and separates nothing. Offsets are code points of the original text.
2. Digests are grouped globally: rows are range-partitioned by 128-bit digest, document and position and
   sorted, so each task streams its keys; the first row of a key is its earliest occurrence, the others
   repeat it. A common key may fill several partitions: the key at a partition's start stays open and is
   settled by a table of at most two rows per partition, which all rows meet.
3. Repeats that follow each other in a document form a span; spans of at least ``min_words`` words are
   removed and reported with their offsets and the documents that keep the text.
4. With ``run_words`` = n, every window of n words with an earlier occurrence that does not overlap it is
   removed too, wherever it begins and ends. Of the windows of about n / 2 words the smallest hash among n / 2
   neighbours is kept (winnowing), so texts that share n words share one of these; only around those that repeat are all
   windows of n words hashed (64 bits) and streamed as in 2.

Documents rank by id, smallest first. Defined cases: a null or empty text has no units; rows that agree
in id and text are one document; a null id ranks last; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.llm.common import U64, body, documents, mixed
from civicspark.session import settled

UNITS = {
    "line": re.compile(r"[^\n]+"),
    "paragraph": re.compile(r"(?:[^\n]|\n(?!\s*\n))+"),
    "segment": re.compile(r"(?:[^\n.!?]++|[.!?](?!\s))++[.!?]?"),
}
_WORDS = re.compile(r"\w+")
_UNIT = "h1 long, h2 long, doc long, raw long, pos int, a int, b int, w int, words int"
_SEEN = "h1 long, h2 long, doc long, raw long, pos int, a int, b int, w int, words int, keeper long, open boolean"


def units(text: str, unit: str, min_unit_words: int):
    """(start, end, words, digest) of the hashed units."""
    for a, b, n, d, _ in _placed_units(text, unit, min_unit_words):
        yield a, b, n, d


def _placed_units(text: str, unit: str, least: int):
    """units() with the number of words before each."""
    at, glued, a, w = 0, [], 0, 0
    for m in UNITS[unit].finditer(text):
        words = _WORDS.findall(text, m.start(), m.end())
        if len(words) >= least:
            glued = []
            yield m.start(), m.end(), len(words), _digest(words), at
        elif words:
            if not glued:
                a, w = m.start(), at
            glued = glued + words
            if len(glued) >= least:
                yield a, m.end(), len(glued), _digest(glued), w
                glued = []
        at += len(words)


def _digest(words: list[str]) -> bytes:
    return xxhash.xxh3_128_digest(" ".join(words).lower().encode())


def _unit_rows(unit: str, least: int):
    def rows(batches):
        for batch in batches:
            out: list[tuple] = []
            for doc, raw, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "raw", "t")), strict=True):
                out += [(d, doc, raw, i, a, b, w, n) for i, (a, b, n, d, w) in enumerate(_placed_units(text, unit, least))]
                if len(out) >= 50_000:
                    yield _pack(out)
                    out = []
            if out:
                yield _pack(out)

    return rows


def _pack(rows: list[tuple]) -> pa.RecordBatch:
    h = np.frombuffer(b"".join(r[0] for r in rows), "<i8").reshape(-1, 2)
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()),
         *[pa.array(c, pa.int32()) for c in columns[3:]]], names=["h1", "h2", "doc", "raw", "pos", "a", "b", "w", "words"])


def _repeats(batches):
    """Streams keys in order. The first key's rows stay open. The last key leaves a mark (words 0) with
    its keeper, since the next partition may go on with it."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("raw", pa.int64()), ("pos", pa.int32()),
                        ("a", pa.int32()), ("b", pa.int32()), ("w", pa.int32()), ("words", pa.int32()), ("keeper", pa.int64()), ("open", pa.bool_())])
    head, last, first = None, None, None  # the first row of the key that goes on, and the row before
    for batch in batches:
        if not batch.num_rows:
            continue
        skip = 0
        if head is not None:
            batch, skip = pa.Table.from_batches([head, last, batch]).combine_chunks().to_batches()[0], 2
        no_id = batch.column("doc").is_null().to_numpy(zero_copy_only=False)
        h1, h2, *rest = (batch.column(c).fill_null(0).to_numpy() for c in schema.names[:9])
        begins = np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
        again = ~begins  # the same document once more
        for x in (no_id, *rest):
            again[1:] &= x[1:] == x[:-1]
        lead = np.flatnonzero(begins)[np.cumsum(begins) - 1]
        first = (h1[0], h2[0]) if first is None else first
        edge = (h1 == first[0]) & (h2 == first[1])
        take = ~again & (edge | ~begins)
        take[:skip] = False
        at = np.flatnonzero(take)
        if len(at):
            open_, lead_at = edge[at], lead[at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1[at], mask=~open_), pa.array(h2[at], mask=~open_), *batch.take(pa.array(at)).columns[2:],
                 pa.array(rest[0][lead_at], mask=open_ | no_id[lead_at]), pa.array(open_)], schema=schema)
        head, last = batch.slice(lead[-1], 1), batch.slice(batch.num_rows - 1, 1)
    if head is not None and (head.column("h1")[0].as_py(), head.column("h2")[0].as_py()) != first:
        yield pa.RecordBatch.from_arrays([*head.columns[:8], pa.array([0], pa.int32()), pa.nulls(1, pa.int64()), pa.array([True])], schema=schema)


# --- word runs -------------------------------------------------------------------------------------------

_RUN = "h long, doc long, raw long, pos int, a int, b int"
_TABLES: list[np.ndarray] = []


def _code_points() -> list[np.ndarray]:
    """By code point: whether it belongs to a word, and its lower case if that is one code point."""
    if not _TABLES:
        every = "".join(map(chr, range(0x110000)))
        member = np.zeros(0x110000, bool)
        member[[m.start() for m in re.finditer(r"\w", every)]] = True
        lower = [c.lower() for c in every]
        _TABLES.extend([member, np.array([ord(x) if len(x) == 1 else ord(c) for c, x in zip(every, lower, strict=True)], U64)])
    return _TABLES


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = {_BASE: np.ones(1, U64), _INVERSE: np.ones(1, U64)}


def _powers(n: int, base: int = _BASE) -> np.ndarray:
    if len(_POWERS[base]) < n:
        _POWERS[base] = np.multiply.accumulate(np.concatenate(([U64(1)], np.full(2 * n, U64(base)))))
    return _POWERS[base][:n]


def _words_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word."""
    member, lower = _code_points()
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    edge = np.diff(np.concatenate(([False], member[codes], [False])).astype(np.int8))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(a):
        return np.zeros(0, U64), a, b
    place = np.flatnonzero(member[codes])
    size = b - a
    nth = np.arange(len(place)) - np.repeat(np.cumsum(size) - size, size)
    h = np.add.reduceat(mixed(lower[codes[place]] + U64(1)) * _powers(int(size.max()))[nth], np.cumsum(size) - size)
    return mixed(h + size.astype(U64)), a, b


def _windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every window of n words: a difference of running sums, shifted back to the first power."""
    if len(h) < n:
        return np.zeros(0, U64)
    sums = np.concatenate((np.zeros(1, U64), np.cumsum(h * _powers(len(h)))))
    return mixed((sums[n:] - sums[:-n]) * _powers(len(h) - n + 1, _INVERSE))


def _least(v: np.ndarray, n: int) -> np.ndarray:
    """Place of the smallest of every n neighbours, the first of equal ones."""
    at, span = np.arange(len(v)), 1
    while span < n:
        step = min(span, n - span)
        left, right = at[:-step], at[step:]
        at, span = np.where(v[right] < v[left], right, left), span + step
    return at


def _run_batch(found: list[tuple]) -> pa.RecordBatch:
    """Of (doc, raw, hashes, positions, starts, ends)."""
    n = [len(x[2]) for x in found]
    whole = [np.concatenate([x[k] for x in found]) for k in (2, 3, 4, 5)]
    at = pa.array(np.repeat(np.arange(len(found)), n))
    doc, raw = pa.array([x[0] for x in found], pa.int64()).take(at), pa.array([x[1] for x in found], pa.int64()).take(at)
    return pa.RecordBatch.from_arrays([pa.array(whole[0].view(np.int64)), doc, raw, *[pa.array(x.astype(np.int32)) for x in whole[1:]]],
                                      names=["h", "doc", "raw", "pos", "a", "b"])


def _batched(each, columns: list[str]):
    def rows(batches):
        for batch in batches:
            found, n = [], 0
            for doc, raw, *x in zip(*(batch.column(c).to_pylist() for c in ("doc", "raw", *columns)), strict=True):
                got = each(*x)
                if len(got[0]):
                    found.append((doc, raw, *got))
                    n += len(got[0])
                if n >= 100_000:
                    yield _run_batch(found)
                    found, n = [], 0
            if found:
                yield _run_batch(found)

    return rows


def _picked(n: int):
    """Windows of n // 2 + 1 words with the smallest hash among (n + 1) // 2 neighbours: n words in a row hold one at least."""
    k = n // 2 + 1

    def each(text: str):
        h, a, b = _words_of(text)
        if len(h) < n:
            return h[:0], a[:0], a[:0], b[:0]
        v = _windows(h, k)
        at = _least(v, n - k + 1)
        at = at[np.diff(at, prepend=-1) > 0]
        return v[at], at, a[at], b[at + k - 1]

    return _batched(each, ["t"])


def _all_around(n: int):
    """All windows of n words that hold one of the picked windows at ``at``."""
    k = n // 2 + 1

    def each(text: str, at: list[int]):
        h, a, b = _words_of(text)
        spots = (np.array(at)[:, None] - np.arange(n - k + 1)).ravel()
        spots = np.unique(spots[(spots >= 0) & (spots <= len(h) - n)])
        return _windows(h, n)[spots], spots, a[spots], b[spots + n - 1]

    return _batched(each, ["t", "at"])


def _twins(batches):
    """The rows whose key a neighbour has, and those of a partition's first and last key."""
    last, first = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        if last is not None:
            batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        h = batch.column("h").to_numpy()
        first = h[0] if first is None else first
        same = h[1:] == h[:-1]
        take = np.concatenate((same, [False])) | np.concatenate(([False], same)) | (h == first)
        take[-1] = False
        last = batch.slice(batch.num_rows - 1)
        out = batch.filter(pa.array(take)).select(["doc", "raw", "pos"])
        if out.num_rows:
            yield out
        if len(h) > 1 and same[-1]:
            yield last.select(["doc", "raw", "pos"])
    if last is not None:
        yield last.select(["doc", "raw", "pos"])


_LATER = "h long, doc long, raw long, pos int, a int, b int, keeper long, open boolean, mark boolean"


def _later(n: int):
    """The rows behind the first of their key that do not overlap it; open rows and marks as in _repeats."""
    schema = pa.schema([("h", pa.int64()), ("doc", pa.int64()), ("raw", pa.int64()), ("pos", pa.int32()), ("a", pa.int32()),
                        ("b", pa.int32()), ("keeper", pa.int64()), ("open", pa.bool_()), ("mark", pa.bool_())])

    def rows(batches):
        head, first = None, None  # the first row of the key that goes on
        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.num_rows
            if head is not None:
                batch = pa.Table.from_batches([head, batch]).combine_chunks().to_batches()[0]
            skip = batch.num_rows - size
            h = batch.column("h").to_numpy()
            begins = np.concatenate(([True], h[1:] != h[:-1]))
            lead = np.flatnonzero(begins)[np.cumsum(begins) - 1]
            first = h[0] if first is None else first
            doc, no_id = batch.column("doc").fill_null(0).to_numpy(), batch.column("doc").is_null().to_numpy(zero_copy_only=False)
            raw, pos = batch.column("raw").to_numpy(), batch.column("pos").to_numpy()
            same = (doc == doc[lead]) & (no_id == no_id[lead]) & (raw == raw[lead])
            edge = h == first
            take = edge | (~begins & ~(same & (pos - pos[lead] < n)))
            take[:skip] = False
            at = np.flatnonzero(take)
            if len(at):
                open_ = edge[at]
                keeper = batch.column("doc").take(pa.array(lead[at]))
                got = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(got.column("h").to_numpy(), mask=~open_), *got.columns[1:],
                     pa.array(keeper.fill_null(0).to_numpy(), mask=open_ | no_id[lead[at]]), pa.array(open_), pa.array(np.zeros(len(at), bool))], schema=schema)
            head = batch.slice(lead[-1], 1)
        if head is not None and head.column("h")[0].as_py() != first:
            yield pa.RecordBatch.from_arrays([*head.columns, pa.nulls(1, pa.int64()), pa.array([True]), pa.array([True])], schema=schema)

    return rows


def _first_of(seen: DataFrame, *key: str) -> DataFrame:
    """The first occurrence of the keys of open rows, two keys a partition at most."""
    first = F.min(F.struct(F.col("doc").isNull().alias("no_id"), F.col("doc").alias("doc"), F.col("raw").alias("raw"), F.col("pos").alias("pos")))
    return seen.where("open").groupBy(*key).agg(first.alias("first"))


def repeated_runs(rows: DataFrame, n: int) -> DataFrame:
    """(doc, raw, pos, a, b, keeper) of the windows of n words of ``rows`` (doc, raw, t) that occur earlier."""
    place = [F.col("doc").asc_nulls_last(), "raw", "pos"]
    picked = settled(rows.mapInArrow(_picked(n), _RUN), "picked").select("h", "doc", "raw", "pos")
    dealt = picked.repartitionByRange("h", *place).sortWithinPartitions("h", *place)
    spots = dealt.mapInArrow(_twins, "doc long, raw long, pos int").groupBy("doc", "raw").agg(F.collect_set("pos").alias("at"))
    spots = spots.withColumnsRenamed({"doc": "s_doc", "raw": "s_raw"})
    met = rows.join(spots.hint("shuffle_hash"), F.col("doc").eqNullSafe(F.col("s_doc")) & (F.col("raw") == F.col("s_raw")))
    dense = settled(met.select("doc", "raw", "t", "at").mapInArrow(_all_around(n), _RUN), "windows")
    dealt = dense.repartitionByRange("h", *place).sortWithinPartitions("h", *place)
    seen = settled(dealt.mapInArrow(_later(n), _LATER), "later")
    met = seen.join(F.broadcast(_first_of(seen, "h")), "h", "left")  # all rows, so that a common key adds none
    near = F.col("first.doc").eqNullSafe(F.col("doc")) & (F.col("first.raw") == F.col("raw")) & (F.col("pos") - F.col("first.pos") < n)
    return met.where(~(F.col("open") & (F.col("mark") | near))).select(
        "doc", "raw", "pos", "a", "b", F.when(F.col("open"), F.col("first.doc")).otherwise(F.col("keeper")).alias("keeper"))


# --- spans -----------------------------------------------------------------------------------------------

def _unit_spans(units_: pa.Array, min_words: int):
    """(first word, end word, start, end, units, keepers) of the spans of repeated units."""
    pos, a, b, w, words = (units_.field(c).to_numpy() for c in ("pos", "a", "b", "w", "words"))
    order = np.argsort(pos, kind="stable")
    pos, a, b, w, words = pos[order], a[order], b[order], w[order], words[order]
    cuts = np.flatnonzero(np.diff(pos) != 1) + 1
    keeper = units_.field("keeper").take(pa.array(order))
    for lo, hi in zip([0, *cuts], [*cuts, len(pos)], strict=True):
        if words[lo:hi].sum() >= min_words:
            yield int(w[lo]), int(w[hi - 1] + words[hi - 1]), int(a[lo]), int(b[hi - 1]), int(hi - lo), set(keeper.slice(lo, hi - lo).unique().to_pylist())


def _run_spans(runs: pa.Array, n: int):
    """The same of windows; those that meet are one."""
    pos, a, b = (runs.field(c).to_numpy() for c in ("pos", "a", "b"))
    order = np.argsort(pos, kind="stable")
    pos, a, b = pos[order], a[order], b[order]
    cuts = np.flatnonzero(np.diff(pos) > n) + 1
    keeper = runs.field("keeper").take(pa.array(order))
    for lo, hi in zip([0, *cuts], [*cuts, len(pos)], strict=True):
        yield int(pos[lo]), int(pos[hi - 1]) + n, int(a[lo]), int(b[hi - 1]), 0, set(keeper.slice(lo, hi - lo).unique().to_pylist())


def _spans(min_words: int, n: int):
    def rows(batches):
        for batch in batches:
            out = []
            found, lists = batch.column("found"), batch.column("runs")
            for i, (doc, raw) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc", "raw")), strict=True)):
                spans = list(_unit_spans(found[i].values, min_words)) if found[i].is_valid and len(found[i].values) else []
                if lists[i].is_valid and len(lists[i].values):
                    spans += _run_spans(lists[i].values, n)
                merged: list[list] = []
                for s in sorted(spans, key=lambda s: s[:4]):
                    if merged and s[0] <= merged[-1][1]:
                        m = merged[-1]
                        m[1], m[2], m[3], m[4], m[5] = max(m[1], s[1]), min(m[2], s[2]), max(m[3], s[3]), m[4] + s[4], m[5] | s[5]
                    else:
                        merged.append(list(s))
                out += [(doc, raw, a, b, k, wb - wa, sorted(x for x in keep if x is not None)) for wa, wb, a, b, k, keep in merged]
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                             names=["doc", "raw", "start", "end", "n_units", "n_words", "keep_doc_ids"])

    return rows


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "segment",
                   min_unit_words: int = 4, min_words: int = 25, run_words: int | None = None) -> DataFrame:
    """One row per removed span: doc, raw (hash of the text), start and end (code points, end exclusive),
    n_units (repeated units), n_words and keep_doc_ids, the documents in which its units and windows occur first."""
    t = body(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(t).alias("raw"), t.alias("t"))
    hashed = settled(rows.mapInArrow(_unit_rows(unit, min_unit_words), _UNIT), "units")
    place = [F.col("doc").asc_nulls_last(), "raw", "pos"]
    dealt = hashed.repartitionByRange("h1", "h2", *place).sortWithinPartitions("h1", "h2", *place, "a", "b", "w", "words")
    seen = settled(dealt.mapInArrow(_repeats, _SEEN), "repeats")
    met = seen.join(F.broadcast(_first_of(seen, "h1", "h2")), ["h1", "h2"], "left")
    same = F.col("first.doc").eqNullSafe(F.col("doc")) & (F.col("first.raw") == F.col("raw")) & (F.col("first.pos") == F.col("pos"))
    gone = met.where(~(F.col("open") & ((F.col("words") == 0) | same))).select(
        "doc", "raw", "pos", "a", "b", "w", "words", F.when(F.col("open"), F.col("first.doc")).otherwise(F.col("keeper")).alias("keeper"))
    unit_row = F.struct("pos", "a", "b", "w", "words", "keeper")
    run_row = F.struct("pos", "a", "b", "keeper")
    if run_words is not None:
        runs = repeated_runs(rows, run_words)
        gone = gone.select("*", F.lit(False).alias("run")).unionByName(runs.select(
            "*", F.lit(None).cast("int").alias("w"), F.lit(None).cast("int").alias("words"), F.lit(True).alias("run")))
    else:
        gone = gone.withColumn("run", F.lit(False))
    grouped = gone.groupBy("doc", "raw").agg(
        F.collect_list(F.when(~F.col("run"), unit_row)).alias("found"), F.collect_list(F.when(F.col("run"), run_row)).alias("runs"))
    return grouped.mapInArrow(_spans(min_words, run_words or 0), 'doc long, raw long, start int, `end` int, n_units int, n_words int, keep_doc_ids array<long>')


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with the spans cut out of their texts; all columns stay."""
    cuts = repeated_spans(docs, id_col, text_col, **how).groupBy(F.col("doc").alias("c_doc"), F.col("raw").alias("c_raw")).agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    packed = docs.select(F.struct("*").alias("doc"), F.col(id_col).cast("long").alias("d_id"), F.xxhash64(body(text_col)).alias("d_raw"))
    met = packed.join(cuts.hint("shuffle_hash"), F.col("d_id").eqNullSafe(F.col("c_doc")) & (F.col("d_raw") == F.col("c_raw")), "left")
    text = F.col("doc").getField(text_col)
    left = F.aggregate(
        "cuts", F.struct(F.lit(0).alias("at"), F.lit("").alias("t")),
        lambda acc, c: F.struct(c["end"].alias("at"), F.concat(acc["t"], F.substr(text, acc["at"] + 1, c["start"] - acc["at"])).alias("t")),
        lambda acc: F.concat(acc["t"], F.substr(text, acc["at"] + 1)))
    met = met.withColumn("left_over", F.when(F.col("cuts").isNull(), text).otherwise(left))
    return met.select(*[F.col("left_over").alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in docs.columns])


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = repeated_spans(documents(spark, sf_dir), min_words=1, run_words=50)
    return out.select(F.col("doc").alias("doc_id"), "start", "end", "n_units", "n_words", "keep_doc_ids")
