"""LM scoring: a Katz back-off model of word pairs with Good-Turing discounts.

P(w | h) = d(c) * c / n(h) for pairs (h, w) met in training c times, else alpha(h) * P(w), and P(w | h) = P(w)
after a word never met. P(w) is discounted in the same way; what its discount leaves is the probability of
the one class of unknown words. h is the word before, or the start of the text; every text ends in an end
token, which is predicted like a word. Counts above ``LARGE`` are trusted (d = 1). A distribution without
any count to discount counts one occurrence more in n(h), so something is always left. alpha(h) spreads exactly
what is left after h over the words not met after h: (1 - sum of P(w | h)) / (1 - sum of P(w)), over the w met.

1. Vocabulary: hashes of the training words with their counts, summed by Spark after a sum per task. The most frequent
   ones (``FREQUENT`` at most, cut at a count) go to all tasks with their counts; all others are met by joins.
2. Every text yields its pairs, as (start word, word, document) with multiplicity, dealt into buckets of about
   ``BUCKET`` tokens by the start word. Start words of more than that are split by the second word over
   several buckets; there are 65 536 of them at most. A task turns about ``RUN`` tokens at a time into
   one row of packed columns per bucket; more than ``FAN`` buckets are dealt in two steps. A document is named
   there by its place: the task, the row of texts in it, and the number in that; neighbours pack to a byte or
   two. Which key a place belongs to is written beside the buckets, by the same tasks.
3. A bucket becomes one row of the table of pairs: start words, words, counts, and in which documents they
   occur. It is written; counts of counts come from a column of it.
4. Left-over mass per start word, and the unigram mass of the words met after it, are summed to the
   table of back-off weights, which is written too.
5. Buckets are read again and every pair scored: met ones at once, the others through the table of weights and the
   vocabulary. Sums per document meet the documents again at the end.

Words are told apart by 64-bit hashes of their lower-cased bytes, rows by a 64-bit hash of id and text.

Defined cases: a null or empty text is its end token alone; a row whose ``held`` is null is held out; repeated
rows count as often as they come, each with the same score; without training rows every token is of the
unknown class, with probability one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspark.llm.common import U64, body, documents, hashed_words, mixed, slices, text_buffers
from civicspark.session import settled

CHUNK = 1 << 20
LARGE = 5
FREQUENT = 1 << 18
RUN, BUCKET, FAN = 1 << 19, 1 << 19, 4096
KEYS = 1 << 20
SPLIT, SPLITS = 1 << 18, 1 << 16
START, END = U64(0x51A7), U64(0xE0D)


# --- texts as tokens ------------------------------------------------------------------------------------------

def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every token, the end of each text included."""
    words, rows = hashed_words(data, offsets)
    texts = len(offsets) - 1
    out = np.full(len(words) + texts, END, U64)
    of = np.empty(len(out), np.int64)
    at = np.arange(len(words)) + rows
    out[at], of[at] = words, rows
    ends = np.cumsum(np.bincount(rows, minlength=texts)) + np.arange(texts)
    of[ends] = np.arange(texts)
    return out, of


def before(words: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The word before each token, or the start."""
    out = np.concatenate([[START], words[:-1]]).astype(U64)
    out[np.flatnonzero(np.diff(of, prepend=-1))] = START
    return out


def _vocabulary(batches):
    for batch in batches:
        data, offsets = text_buffers(batch.column("t"))
        held, sums = [], []
        for lo, hi in slices(offsets, CHUNK):
            words, n = np.unique(tokens(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])[0], return_counts=True)
            held.append(words)
            sums.append(n)
        if held:
            words, back = np.unique(np.concatenate(held), return_inverse=True)
            n = np.bincount(back, np.concatenate(sums)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["w", "c"])


# --- the model ---------------------------------------------------------------------------------------------------

def discounts(counts: np.ndarray) -> np.ndarray:
    """d(0) to d(LARGE) from the counts of counts of 1 to LARGE + 1: Katz' form of Good-Turing. Where that
    leaves (0, 1), as on small or odd tables, a constant is taken from every count instead."""
    n = counts.astype(float)
    r = np.arange(1, LARGE + 1)
    if (n[:LARGE] > 0).all():
        rest = (LARGE + 1) * n[LARGE] / n[0]
        if rest < 1:
            d = ((r + 1) * n[1:] / (r * n[:-1]) - rest) / (1 - rest)
            if (d > 0).all() and (d < 1).all():
                return np.concatenate([[0.0], d])
    less = min(0.9, max(0.1, n[0] / (n[0] + 2 * n[1]))) if n[0] + n[1] else 0.5
    return np.concatenate([[0.0], (r - less) / r])


def discounted(d: np.ndarray, c: np.ndarray) -> np.ndarray:
    """d(c) * c."""
    return np.where(c > LARGE, c, d[np.minimum(c, LARGE)] * c)


@dataclass
class Model:
    """What every task knows: unigram totals, the frequent words by rank, the start words that are split."""

    total: int  # training tokens
    distinct: int
    texts: int  # training texts
    unigram: np.ndarray  # discounts
    extra: int  # 1 if no word has a count to discount
    words: np.ndarray  # frequent words by rank
    counts: np.ndarray
    buckets: int = 1
    pair: np.ndarray = field(default_factory=lambda: np.zeros(LARGE + 1))
    low: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))  # split start words with a count to discount
    unknown: float = 1.0

    def __post_init__(self):
        self.order = np.argsort(self.words)
        self.by_hash = self.words[self.order]
        limit = max(SPLIT, self.total // SPLITS)
        names, n = np.append(self.words, START), np.append(self.counts, self.texts)
        names, n = names[n > limit], n[n > limit]
        order = np.argsort(names)
        self.split, self.split_count = names[order], n[order]
        self.split_parts = -(-self.split_count // limit)

    def rank(self, words: np.ndarray) -> np.ndarray:
        """Rank of each word, -1 if it is not frequent."""
        if not len(self.by_hash):
            return np.full(len(words), -1, np.int64)
        at = np.minimum(np.searchsorted(self.by_hash, words), len(self.by_hash) - 1)
        return np.where(self.by_hash[at] == words, self.order[at], -1)

    def split_at(self, starts: np.ndarray) -> np.ndarray:
        if not len(self.split):
            return np.full(len(starts), -1, np.int64)
        at = np.minimum(np.searchsorted(self.split, starts), len(self.split) - 1)
        return np.where(self.split[at] == starts, at, -1)

    def bucket(self, starts: np.ndarray, words: np.ndarray) -> np.ndarray:
        at = self.split_at(starts)
        part = np.zeros(len(starts), U64)
        if (at >= 0).any():
            parts = self.split_parts[at[at >= 0]].astype(U64)
            part[at >= 0] = mixed(words[at >= 0] ^ U64(0xB5)) % parts + U64(1)
        return (mixed(starts + part * U64(0x9E3779B97F4A7C15)) % U64(self.buckets)).astype(np.int64)

    def alone(self, c: np.ndarray) -> np.ndarray:
        """P(w) of words with training count c; 0 stands for the class of unknown words."""
        return np.where(c > 0, discounted(self.unigram, c) / max(self.total + self.extra, 1), self.unknown)


def fitted(vocabulary: DataFrame, texts: int) -> Model:
    """Totals and the frequent words. Words are binned by their count, so one small aggregate tells the
    counts of counts, and where to cut."""
    bin_ = F.when(F.col("c") <= LARGE + 1, F.col("c")).otherwise(F.lit(LARGE + 2) + F.floor(4 * F.log2("c")))
    binned = vocabulary.withColumn("bin", bin_.cast("int"))
    bins = sorted(binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c")).collect(), reverse=True)  # 300 at most
    counts = np.zeros(LARGE + 1, np.int64)
    cut, room = 1 << 30, FREQUENT
    for b in bins:
        if b["bin"] <= LARGE + 1:
            counts[b["bin"] - 1] = b["n"]
        room -= b["n"]
        if room >= 0:
            cut = b["bin"]
    table = binned.where(F.col("bin") >= cut).select("w", "c").toArrow()
    words, n = table.column("w").to_numpy().view(U64), table.column("c").to_numpy()
    order = np.lexsort((words, -n))
    total = sum(b["c"] for b in bins)
    d = discounts(counts)
    extra = int(not counts[:LARGE].any())
    left = sum((1 - d[r]) * r * counts[r - 1] for r in range(1, LARGE + 1)) + extra
    return Model(total, sum(b["n"] for b in bins), texts, d, extra, words[order], n[order], unknown=left / max(total + extra, 1))


# --- unigrams per row -------------------------------------------------------------------------------------------------

_ROWS = "key long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, rare array<long>, times array<int>"


def _unigrams(model: Model):
    """Token counts and base scores by the frequent words; the other words with their multiplicity."""
    scale = model.total + 0.1 * (model.distinct + 1)
    base = np.log10((model.counts + 0.1) / scale)

    def rows(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column("t"))
            for lo, hi in slices(offsets, CHUNK):
                words, of = tokens(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                rank = model.rank(words)
                known, n = rank >= 0, hi - lo
                names, code = np.unique(words[~known], return_inverse=True)
                each, times = np.unique(of[~known] * max(len(names), 1) + code, return_counts=True)
                row, code = np.divmod(each, max(len(names), 1))
                ends = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
                own = batch.slice(lo, n)
                yield pa.RecordBatch.from_arrays(
                    [own.column("key"), own.column("doc_id"), own.column("held"), pa.array(np.bincount(of, minlength=n)),
                     pa.array(np.bincount(of[known], minlength=n)), pa.array(np.bincount(of[known], base[rank[known]], minlength=n).astype(float)),
                     pa.ListArray.from_arrays(ends, names[code].view(np.int64)), pa.ListArray.from_arrays(ends, times.astype(np.int32))],
                    names=["key", "doc_id", "held_out", "n_tokens", "n_known", "base", "rare", "times"])

    return rows


# --- pairs -------------------------------------------------------------------------------------------------------------

_KINDS = {"starts": "<u8", "widths": "<u4", "words": "<i4", "rare": "<u8", "counts": "<u8", "runs": "<u4", "at": "<u4", "times": "<u4", "docs": "<u8", "trains": "u1"}
_POSTINGS = "bucket int, " + ", ".join(f"{c} binary" for c in _KINDS) + ", first long, keys binary"
_PLACES = pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in _KINDS], ("first", pa.int64()), ("keys", pa.binary())])
_PAIRS = _POSTINGS + ", n array<long>, lows array<long>"


def pack(values: np.ndarray, kind: str) -> bytes:
    """Numbers as compressed planes of their bytes."""
    raw = np.ascontiguousarray(values).astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize)
    return zstandard.ZstdCompressor(level=1).compress(raw.T.tobytes())


def unpack(blob: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


@dataclass
class Pairs:
    """Sorted pairs (start word, word) with, for each, the documents it occurs in and how often."""

    start: np.ndarray
    word: np.ndarray
    runs: np.ndarray  # postings of a pair
    at: np.ndarray  # place of each posting's document in docs
    times: np.ndarray
    docs: np.ndarray
    trains: np.ndarray

    @staticmethod
    def of(start, word, doc, times, docs, trains) -> Pairs:
        """From unsorted postings; those of one pair and document are summed."""
        starts, s = np.unique(start, return_inverse=True)
        words, w = np.unique(word, return_inverse=True)
        pair = s * max(len(words), 1) + w
        key, back = np.unique(pair * max(len(docs), 1) + doc, return_inverse=True)
        times = np.bincount(back, times).astype(np.int64)
        pair, at = np.divmod(key, max(len(docs), 1))
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        s, w = np.divmod(pair[first], max(len(words), 1))
        return Pairs(starts[s], words[w], np.diff(np.append(first, len(pair))), at, times, docs, trains)

    def packed(self, model: Model, counts: np.ndarray | None = None) -> list[bytes]:
        first = np.flatnonzero(np.concatenate([[True], self.start[1:] != self.start[:-1]])) if len(self.start) else np.zeros(0, np.int64)
        code = model.rank(self.word)
        rare, place = np.unique(self.word[code < 0], return_inverse=True)
        code[code < 0] = -1 - place
        columns = {"starts": self.start[first], "widths": np.diff(np.append(first, len(self.start))), "words": code, "rare": rare,
                   "counts": np.zeros(0) if counts is None else counts, "runs": self.runs, "at": self.at, "times": self.times,
                   "docs": self.docs, "trains": self.trains}
        return [pack(columns[c], kind) for c, kind in _KINDS.items()]

    @staticmethod
    def unpacked(row: dict, model: Model) -> tuple[Pairs, np.ndarray]:
        col = {c: unpack(row[c], kind) for c, kind in _KINDS.items()}
        code = col["words"].astype(np.int64)
        word = np.empty(len(code), U64)
        word[code >= 0] = model.words[code[code >= 0]]
        word[code < 0] = col["rare"][-1 - code[code < 0]]
        start = np.repeat(col["starts"], col["widths"])
        return Pairs(start, word, col["runs"].astype(np.int64), col["at"].astype(np.int64), col["times"].astype(np.int64),
                     col["docs"].astype(U64), col["trains"]), col["counts"].astype(np.int64)

    def posting(self, of_pair: np.ndarray) -> np.ndarray:
        return np.repeat(of_pair, self.runs)

    @staticmethod
    def merged(parts: list[Pairs]) -> Pairs:
        docs, back = np.unique(np.concatenate([p.docs for p in parts]), return_inverse=True)
        trains = np.zeros(len(docs), np.uint8)
        trains[back] = np.concatenate([p.trains for p in parts])
        base = np.cumsum([0] + [len(p.docs) for p in parts])
        return Pairs.of(np.concatenate([p.posting(p.start) for p in parts]), np.concatenate([p.posting(p.word) for p in parts]),
                        np.concatenate([back[p.at + b] for p, b in zip(parts, base, strict=False)]),
                        np.concatenate([p.times for p in parts]), docs, trains)

    def dealt(self, model: Model, share: int) -> pa.RecordBatch:
        """One row per bucket, or per ``share`` neighbouring buckets."""
        bucket = model.bucket(self.start, self.word) // share
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        ends = np.concatenate([[0], np.cumsum(self.runs)])
        names, rows = [], []
        for pairs in np.split(order, cuts[1:]) if len(order) else []:
            runs = self.runs[pairs]
            place = np.repeat(ends[pairs] - (np.cumsum(runs) - runs), runs) + np.arange(int(runs.sum()))
            used, at = np.unique(self.at[place], return_inverse=True)
            part = Pairs(self.start[pairs], self.word[pairs], runs, at, self.times[place], self.docs[used], self.trains[used])
            names.append(int(bucket[pairs[0]]))
            rows.append(part.packed(model))
        columns = [pa.array([r[i] for r in rows], pa.binary()) for i in range(len(_KINDS))]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), *columns, pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.binary())], schema=_PLACES)


def _keys_of(first: int, keys: np.ndarray) -> pa.RecordBatch:
    """The keys of the places from ``first`` on, as a row below all buckets."""
    at = -1 - int(mixed(np.array([first], U64))[0] % U64(1 << 20))
    return pa.RecordBatch.from_pylist([{"bucket": at, "first": first, "keys": pack(keys, "<u8")}], schema=_PLACES)


def _places(batches):
    for batch in batches:
        for row in batch.to_pylist():
            keys = unpack(row["keys"], "<u8")
            yield pa.RecordBatch.from_arrays([pa.array(row["first"] + np.arange(len(keys))), pa.array(keys.view(np.int64))], names=["place", "key"])


def _postings(model: Model, share: int):
    def rows(batches):
        held, size = [], 0
        context = TaskContext.get()
        first = (context.partitionId() if context else 0) << 40

        def close():
            start, word, doc, keys, held_out = (np.concatenate([h[i] for h in held]) for i in range(5))
            docs = U64(first) + np.arange(len(keys), dtype=U64)
            yield _keys_of(first, keys)
            yield Pairs.of(start, word, doc, np.ones(len(doc), np.int64), docs, (~held_out).astype(np.uint8)).dealt(model, share)

        texts = 0
        for batch in batches:
            data, offsets = text_buffers(batch.column("t"))
            keys, out = batch.column("key").to_numpy().view(U64), batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi in slices(offsets, CHUNK):
                words, of = tokens(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                held.append((before(words, of), words, of + texts, keys[lo:hi], out[lo:hi]))
                texts, size = texts + hi - lo, size + len(words)
                if size >= RUN:
                    yield from close()
                    first += texts
                    held, size, texts = [], 0, 0
        if held:
            yield from close()

    return rows


def _dealt_again(model: Model):
    def rows(batches):
        parts, size = [], 0
        for batch in batches:
            placed = batch.column("keys").is_valid()
            if placed.true_count:
                yield batch.filter(placed)
            for row in batch.filter(pc.invert(placed)).to_pylist():
                parts.append(Pairs.unpacked(row, model)[0])
                size += len(parts[-1].at)
                if size >= RUN:
                    yield Pairs.merged(parts).dealt(model, 1)
                    parts, size = [], 0
        if parts:
            yield Pairs.merged(parts).dealt(model, 1)

    return rows


def _counted(model: Model):
    """A bucket as one row, with counts, counts of counts, and the split start words that have a count to discount."""

    def bucket(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return table.append_column("n", pa.nulls(len(table), pa.list_(pa.int64()))).append_column("lows", pa.nulls(len(table), pa.list_(pa.int64())))
        p = Pairs.merged([Pairs.unpacked(row, model)[0] for row in table.to_pylist()])
        c = np.bincount(p.posting(np.arange(len(p.runs))), p.times * p.trains[p.at], minlength=len(p.runs)).astype(np.int64)
        n = np.bincount(np.minimum(c, LARGE + 2), minlength=LARGE + 3)[1:LARGE + 2]
        lows = np.unique(p.start[(c > 0) & (c <= LARGE) & (model.split_at(p.start) >= 0)])
        columns = [pa.array([blob], pa.binary()) for blob in p.packed(model, c)]
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), *columns, pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([n.tolist()], pa.list_(pa.int64())),
                                     pa.array([lows.view(np.int64).tolist()], pa.list_(pa.int64()))], names=[*_PLACES.names, "n", "lows"])

    return bucket


class Bucket:
    """A row of the table of pairs with everything that holds inside it."""

    def __init__(self, row: dict, model: Model):
        self.pairs, self.c = Pairs.unpacked(row, model)
        p, c = self.pairs, self.c
        self.starts, self.of = np.unique(p.start, return_inverse=True)
        here = np.bincount(self.of, c, minlength=len(self.starts))
        low = np.bincount(self.of, (c > 0) & (c <= LARGE), minlength=len(self.starts)) > 0
        at = model.split_at(self.starts)
        self.split = at >= 0
        n = here.copy()
        if self.split.any():
            n[self.split] = model.split_count[at[self.split]]
            low[self.split] = np.isin(self.starts[self.split], model.low)
        self.size = n + ~low  # one more where no count is discounted
        self.share = here / np.maximum(n, 1)  # of the start word's occurrences, those in this bucket
        self.more = (~low) * self.share
        self.seen = c > 0
        self.rank = model.rank(p.word)


_MASS = "h long, left double, low double, w long"


def _mass(model: Model):
    """Per start word what its discounts leave, and the unigram mass of the frequent words met after it;
    each of the other words met after it as a row of its own."""
    alone = model.alone(model.counts)

    def rows(batches):
        for batch in batches:
            for row in batch.to_pylist():
                b = Bucket(row, model)
                seen = np.flatnonzero(b.seen)
                left = np.bincount(b.of[seen], b.c[seen] - discounted(model.pair, b.c[seen]), minlength=len(b.starts)) + b.more
                often = seen[b.rank[seen] >= 0]
                low = np.bincount(b.of[often], alone[b.rank[often]], minlength=len(b.starts))
                met = np.flatnonzero(b.share > 0)
                h = b.starts[met].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(left[met] / b.size[met], pa.float64()), pa.array(low[met].astype(float)), pa.nulls(len(met), pa.int64())],
                                                 names=["h", "left", "low", "w"])
                rare = seen[b.rank[seen] < 0]
                none = pa.nulls(len(rare), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(b.starts[b.of[rare]].view(np.int64)), none, none, pa.array(b.pairs.word[rare].view(np.int64))],
                                                 names=["h", "left", "low", "w"])

    return rows


_SCORES = "kind string, place long, term long, times long, s double"


def _scores(model: Model):
    """kind 'sum': what is known of a document in this bucket; 'start', 'split': a weight of a start word to
    be added ``times`` times; 'word': P(w) of a word that is not frequent."""
    alone = np.log10(model.alone(model.counts))

    def rows(batches):
        sums = Sums()
        for batch in batches:
            for row in batch.to_pylist():
                b = Bucket(row, model)
                p = b.pairs
                s = np.zeros(len(b.c))
                s[b.seen] = np.log10(discounted(model.pair, b.c[b.seen]) / b.size[b.of[b.seen]])
                often = ~b.seen & (b.rank >= 0)
                s[often] = alone[b.rank[often]]
                known = np.bincount(p.at, p.posting(s) * p.times, minlength=len(p.docs))
                times = np.bincount(p.at, p.times, minlength=len(p.docs)).astype(np.int64)
                if sums.add(p.docs, known, times):
                    yield sums.out()
                unseen = p.posting(~b.seen)
                at, start, word, times = p.at[unseen], p.posting(b.of)[unseen], p.posting(p.word)[unseen], p.times[unseen]
                rare = p.posting(b.rank < 0)[unseen]
                yield _scored("word", p.docs[at[rare]], word[rare], times[rare], None)
                size = len(b.starts)
                for kind, some in (("split", b.split), ("start", ~b.split & (b.share > 0))):
                    chosen = some[start]
                    each, back = np.unique(at[chosen] * max(size, 1) + start[chosen], return_inverse=True)
                    doc, h = np.divmod(each, max(size, 1))
                    yield _scored(kind, p.docs[doc], b.starts[h], np.bincount(back, times[chosen], minlength=len(each)).astype(np.int64), None)
        yield sums.out()

    return rows


class Sums:
    """Sums per document over the buckets of a task, for at most ``KEYS`` documents and a bucket's at a time."""

    def __init__(self):
        self.keys, self.s, self.times = np.zeros(0, U64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, s: np.ndarray, times: np.ndarray) -> bool:
        """Whether it is time to give them out."""
        self.keys, back = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        self.s = np.bincount(back, np.concatenate([self.s, s]), minlength=len(self.keys))
        self.times = np.bincount(back, np.concatenate([self.times, times]), minlength=len(self.keys)).astype(np.int64)
        return len(self.keys) >= KEYS

    def out(self) -> pa.RecordBatch:
        batch = _scored("sum", self.keys, None, self.times, self.s)
        self.__init__()
        return batch


def _scored(kind, keys, terms, times, s) -> pa.RecordBatch:
    n = len(keys)
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * n, pa.string()), pa.array(keys.view(np.int64)), pa.nulls(n, pa.int64()) if terms is None else pa.array(terms.view(np.int64)),
         pa.array(times, pa.int64()), pa.nulls(n, pa.float64()) if s is None else pa.array(s, pa.float64())], names=["kind", "place", "term", "times", "s"])


# --- the operator ------------------------------------------------------------------------------------------------------

@dataclass
class Tables:
    """The model as written tables: (w, c) of words, rows of pairs, (h, weight) of start words, (place, key) of documents."""

    model: Model
    vocabulary: DataFrame
    pairs: DataFrame
    weights: DataFrame
    places: DataFrame


def _alone(model: Model, c: Column) -> Column:
    """P(w) by training count, null for unknown words."""
    d = F.array(*[F.lit(float(x)) for x in model.unigram])
    share = F.when(c > LARGE, c).otherwise(F.get(d, c.cast("int")) * c) / max(model.total + model.extra, 1)
    return F.coalesce(share, F.lit(float(model.unknown)))


def trained(texts: DataFrame) -> Tables:
    """``texts``: key, held, t. Pairs of held-out rows are kept beside the counts, without entering them."""
    train = texts.where("not held")
    words = settled(train.select("t").mapInArrow(_vocabulary, "w long, c long").groupBy("w").agg(F.sum("c").alias("c")), "words")
    ends = words.where(F.col("w") == int(np.array(END).view(np.int64))).first()
    model = fitted(words, ends["c"] if ends else 0)
    model.buckets = max(1, -(-model.total // BUCKET))
    share = -(-model.buckets // FAN)
    pairs = texts.select("key", "held", "t").mapInArrow(_postings(model, share), _POSTINGS)
    if share > 1:
        pairs = pairs.repartition("bucket").mapInArrow(_dealt_again(model), _POSTINGS)
    pairs = settled(pairs.groupBy("bucket").applyInArrow(_counted(model), _PAIRS), "pairs")
    places = pairs.where("keys is not null").select("first", "keys").mapInArrow(_places, "place long, key long")
    pairs = pairs.where("bucket >= 0").drop("first", "keys")
    counts = pairs.select(F.posexplode("n").alias("r", "n")).groupBy("r").agg(F.sum("n").alias("n")).collect()  # LARGE + 1 rows
    model.pair = discounts(np.array([n for _, n in sorted((r["r"], r["n"]) for r in counts)] or [0] * (LARGE + 1)))
    lows = pairs.select(F.explode("lows").alias("h")).distinct().toArrow().column("h").to_numpy()  # SPLITS at most
    model.low = lows.view(U64)
    mass = settled(pairs.mapInArrow(_mass(model), _MASS), "mass")
    rare = mass.where("w is not null").select("h", F.col("w").alias("m")).join(words, F.col("m") == F.col("w"))
    rare = rare.select("h", F.lit(0.0).alias("left"), _alone(model, F.col("c")).alias("low"))
    mass = mass.where("w is null").select("h", "left", "low").unionAll(rare).groupBy("h").agg(F.sum("left").alias("left"), F.sum("low").alias("low"))
    weights = settled(mass.select("h", F.log10(F.col("left") / (1 - F.col("low"))).alias("weight")), "weights")
    return Tables(model, words, pairs, weights, places)


def scored(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    t = body(text_col)
    texts = docs.select(F.xxhash64(F.col(id_col), t).alias("key"), F.col(id_col).cast("long").alias("doc_id"),
                        F.coalesce(held, F.lit(True)).alias("held"), t.alias("t"))
    made = trained(texts)
    model = made.model
    rows = settled(texts.mapInArrow(_unigrams(model), _ROWS).withColumn("rid", F.monotonically_increasing_id()), "rows")
    scale = float(model.total + 0.1 * (model.distinct + 1))
    rare = rows.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("rid", F.col("x.rare").alias("m"), F.col("x.times").alias("n"))
    rare = rare.join(made.vocabulary, F.col("m") == F.col("w"), "left").groupBy("rid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"),
        F.sum(F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 0.1) / scale)).alias("more_base"))

    parts = settled(made.pairs.mapInArrow(_scores(model), _SCORES), "scores")
    added = F.coalesce(F.col("times") * F.col("weight"), F.lit(0.0)).alias("s")
    few = made.weights.join(F.broadcast(docs.sparkSession.createDataFrame([(int(h),) for h in model.split.view(np.int64)], "k long")), F.col("h") == F.col("k"), "left_semi")
    sums = [parts.where("kind = 'sum'").select("place", "s", "times"),
            parts.where("kind = 'split'").join(F.broadcast(few), F.col("term") == F.col("h"), "left").select("place", added, F.lit(0).alias("times")),
            parts.where("kind = 'start'").join(made.weights, F.col("term") == F.col("h"), "left").select("place", added, F.lit(0).alias("times")),
            parts.where("kind = 'word'").join(made.vocabulary, F.col("term") == F.col("w"), "left").select(
                "place", (F.col("times") * F.log10(_alone(model, F.col("c")))).alias("s"), F.lit(0).alias("times"))]
    total = sums[0]
    for more in sums[1:]:
        total = total.unionAll(more)
    total = total.groupBy("place").agg(F.sum("s").alias("s"), F.sum("times").alias("times")).join(made.places, "place")
    # equal rows share a key: their sums and their numbers of tokens grow alike
    total = total.groupBy("key").agg(F.sum("s").alias("s"), F.sum("times").alias("met")).withColumnRenamed("key", "k")
    out = rows.join(rare.withColumnRenamed("rid", "r"), F.col("rid") == F.col("r"), "left").join(total, F.col("key") == F.col("k"), "left")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
                      F.lit(model.total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
                      (F.col("s") * F.col("n_tokens") / F.col("met")).alias("score"))


def op11_katz(spark, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    return scored(documents(spark, sf_dir), held)
