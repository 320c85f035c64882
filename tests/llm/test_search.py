"""LM scoring, ranked search and hard negatives against brute force, on small tables with nulls, empty and long
texts, ties, repeated rows and clashing column names."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from civicspark.llm import katz, lexical, negatives
from civicspark.llm.common import documents

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
EXTRA = "key string, t string, n int, score string, h string, w string, rank int, q int, item_id string"
NOISE = ("a", "b", 1, "c", "d", "e", 2, 3, "f")


def table(spark, rows):
    return spark.createDataFrame([(*r, *NOISE) for r in rows], f"doc_id long, text string, {EXTRA}").repartition(3)


def prose(seed, n):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(n)]
    return " ".join(w.upper() if rng.random() < 0.1 else w for w in words)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, prose(i, 60 + i % 50)) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n"), (103, "one"), (103, "one"), (103, "Two one"), (None, "no id here"), (None, None),
             (104, "the the " * 4000), (105, "x" * 30000), (106, "ÄÖ é ß İ"), (107, rows[3][1]), (108, rows[3][1]), (5, rows[5][1])]
    return table(spark, rows), rows


# --- LM scoring -------------------------------------------------------------------------------------------------------

def words_of(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None]


def good_turing(counts):
    n = Counter(counts)
    if all(n[r] for r in range(1, 6)):
        rest = 6 * n[6] / n[1]
        if rest < 1:
            d = {r: ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) for r in range(1, 6)}
            if all(0 < x < 1 for x in d.values()):
                return d
    less = min(0.9, max(0.1, n[1] / (n[1] + 2 * n[2]))) if n[1] + n[2] else 0.5
    return {r: (r - less) / r for r in range(1, 6)}


class Katz:
    def __init__(self, texts):
        uni, pair = Counter(), defaultdict(Counter)
        for t in texts:
            uni.update(t)
            for h, w in zip(["<s>", *t[:-1]], t, strict=True):
                pair[h][w] += 1
        self.uni, self.total = uni, sum(uni.values())
        self.alone, self.unknown = self.table(uni, good_turing(uni.values()))
        d = good_turing([c for f in pair.values() for c in f.values()])
        self.after, self.alpha = {}, {}
        for h, f in pair.items():
            self.after[h], left = self.table(f, d)
            self.alpha[h] = left / (1 - math.fsum(self.alone[w] for w in f))

    @staticmethod
    def table(counts, d):
        size = sum(counts.values()) + (not any(c <= 5 for c in counts.values()))
        p = {w: d.get(c, 1) * c / max(size, 1) for w, c in counts.items()}
        return p, 1 - math.fsum(p.values())

    def p(self, h, w):
        if w in self.after.get(h, {}):
            return self.after[h][w]
        return self.alpha.get(h, 1) * self.alone.get(w, self.unknown)


def held(i):
    return i is None or zlib.crc32(str(i).encode()) % 10 == 0


def expected(rows):
    tokens = [words_of(t) for _, t in rows]
    model = Katz([t for (i, _), t in zip(rows, tokens, strict=True) if not held(i)])
    n, v = model.total, len(model.uni)
    return model, sorted((i if i is not None else -1, held(i), len(t), sum(w in model.uni for w in t), n,
                          math.fsum(math.log10((model.uni[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t),
                          math.fsum(math.log10(model.p(h, w)) for h, w in zip(["<s>", *t[:-1]], t, strict=True)))
                         for (i, _), t in zip(rows, tokens, strict=True))


def scores(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)
                  for r in katz.scored(df, F.crc32(F.col("doc_id").cast("string")) % 10 == 0).collect())


@pytest.mark.parametrize("small", [False, True])
def test_katz(spark, odd, monkeypatch, small):
    """With small limits: rare words, split start words, many buckets dealt in two steps."""
    if small:
        for name, value in {"FREQUENT": 20, "SPLIT": 40, "SPLITS": 1 << 40, "BUCKET": 300, "FAN": 5}.items():
            monkeypatch.setattr(katz, name, value)
    df, rows = odd
    found, (_, want) = scores(df), expected(rows)
    assert [r[:5] for r in found] == [r[:5] for r in want]
    for a, b in zip(found, want, strict=True):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_katz_is_normalised(odd):
    model, _ = expected(odd[1])
    for h in [*list(model.after)[:40], "<s>", "never met"]:
        assert math.fsum(model.p(h, w) for w in model.uni) + model.alpha.get(h, 1) * model.unknown == pytest.approx(1, abs=1e-9)


def test_katz_odd_tables(spark):
    assert scores(table(spark, [(1, "a")]).where("doc_id > 1")) == []
    only_held = next(i for i in range(100) if held(i))
    assert scores(table(spark, [(only_held, "a b")])) == [(only_held, True, 3, 0, 0, pytest.approx(0), 0.0)]
    train = next(i for i in range(100) if not held(i))
    rows = [(train, "a b a b"), (only_held, "a c")]
    assert [r[6] for r in scores(table(spark, rows))] == pytest.approx([r[6] for r in expected(rows)[1]])


def test_katz_beats_the_unigram_on_held_out_texts(spark, sf_dir):
    rows = [r for r in katz.op11_katz(spark, sf_dir).collect() if r.held_out]
    assert len(rows) >= 5 and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_katz_documents_take_few_bytes_in_a_bucket():
    """Their keys are told once, not in every bucket they have a pair in."""
    n = 2000
    keys = katz.mixed(np.arange(n, dtype=np.uint64)).view(np.int64)
    words = [f"w{i % 97}" for i in range(n)]
    batch = pa.RecordBatch.from_pydict({"key": keys, "held": np.zeros(n, bool), "t": [f"{w} a b {w}" for w in words]})
    model = katz.Model(5 * n, 100, n, np.zeros(katz.LARGE + 1), 0, np.zeros(0, np.uint64), np.zeros(0, np.int64), buckets=8)
    rows = [r for b in katz._postings(model, 1)(iter([batch])) for r in b.to_pylist()]
    dealt = [r for r in rows if r["keys"] is None]
    assert sum(len(r["docs"]) for r in dealt) < 2 * sum(len(katz.unpack(r["docs"], "<u8")) for r in dealt)
    told = {r["first"] + i: k for r in rows if r["keys"] is not None for i, k in enumerate(katz.unpack(r["keys"], "<u8").view(np.int64))}
    assert sorted(told.values()) == sorted(keys) and {d for r in dealt for d in katz.unpack(r["docs"], "<u8").tolist()} == set(told)


def test_pack():
    for kind in ("<u8", "<u4", "<i4", "u1"):
        values = np.array([0, 1, 5, 127, 1], kind)
        assert (katz.unpack(katz.pack(values, kind), kind) == values).all()
        assert len(katz.unpack(katz.pack(values[:0], kind), kind)) == 0


# --- ranked search ------------------------------------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def by_full_scan(rows, items, k):
    docs = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in rows]
    lengths = [sum(c.values()) for _, c in docs]
    n, total = sum(x > 0 for x in lengths), sum(lengths)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        terms = set(TERM.findall((text or "").translate(LOWER)))
        found = []
        for (i, c), length in zip(docs, lengths, strict=True):
            m = 10 + 90 * length * n // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if s > 0:
                found.append((-s, i is None, i))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(found[:k], 1)]
    return sorted(out, key=repr)


def items_table(spark, items):
    return spark.createDataFrame([(*r, "x", 1) for r in items], "item_id long, text string, doc_id string, score int")


ITEMS = [(1, prose(3, 20)), (2, "one, two. ONE"), (3, None), (4, ""), (5, "nowhere"), (None, "the W1"), (6, "w1 w2"), (6, "w1 w2"), (7, "Äö é w1")]


@pytest.mark.parametrize("k,block", [(10, 1 << 18), (3, 4)])
def test_ranked(spark, odd, k, block):
    df, rows = odd
    found = [tuple(r) for r in lexical.ranked(df, items_table(spark, ITEMS), k, block_terms=block).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(found, key=repr) == by_full_scan(rows, ITEMS, k)


def test_ranked_empty(spark, odd):
    df, _ = odd
    assert lexical.ranked(df.where("doc_id < 0"), items_table(spark, ITEMS)).count() == 0
    assert lexical.ranked(df, items_table(spark, ITEMS).where("item_id < 0")).count() == 0


def test_shards_stop_early_with_the_same_result():
    rng = np.random.default_rng(3)
    top = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    sums = Counter()
    terms = np.arange(6)
    for base in (0, 5000, 10000):
        term, doc = np.divmod(rng.choice(6 * 5000, 9000, replace=False), 5000)
        impact = np.floor(rng.pareto(1, len(term)) * 10).astype(np.int64)
        for d, x in zip(doc, impact, strict=True):
            sums[int(d) + base] += int(x)
        shard = lexical.Shard(term, doc, impact, np.arange(base, base + 5000), 6)
        top = shard.search(terms, top, 10)
    want = sorted(((-s, d) for d, s in sums.items() if s > 0))[:10]
    assert list(zip((-top[0]).tolist(), top[1].tolist(), strict=True)) == want


# --- hard negatives --------------------------------------------------------------------------------------------------------

def mined(rows, positives=5, negatives_=10):
    valid = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            label = (label + 1) % 10 if i % 7 == 0 else label
            valid[i] = min(valid.get(i, (label, [math.floor(256 * x) for x in v])), (label, [math.floor(256 * x) for x in v]))
    out = []
    for a, (la, va) in valid.items():
        if a % 100:
            continue
        s = {i: sum(x * y for x, y in zip(va, v)) for i, (_, v) in valid.items() if i != a}  # noqa: B905
        near = sorted((-s[i], i) for i in s if valid[i][0] == la)[:positives]
        for ps, p in near:
            ps = -ps
            band = sorted((-s[i], i) for i in s if valid[i][0] != la and 30 * ps <= 100 * s[i] <= 90 * ps)[:negatives_]
            out += [(a, p, r, i, ps, -x) for r, (x, i) in enumerate(band, 1)]
    return sorted(out)


def vectors(seed, n=900, dims=8):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(4), [rng.gauss(0, 0.4) * (1 + i % 5) for _ in range(dims)]) for i in range(n)]
    rows += [(2000 + i, 1, rows[5][2]) for i in range(120)]  # many copies
    rows += [(None, 1, rows[0][2]), (3001, None, rows[0][2]), (3002, 1, None), (3003, 1, [0.1] * 7 + [None]), (3004, 1, [float("nan")] * 8),
             (3005, 2, [float("inf")] * 8), (3100, 2, [0.0] * 8), (3006, 1, []), (3200, 1, []), (3007, 1, [0.5] * 3), (3300, 2, [0.7] * 3),
             (100, 3, rows[7][2]), (7, 0, rows[8][2]), (3400, 9, [0.1] * 8), (3500, 8, [-0.2] * 8), (3501, 8, [0.2] * 8)]
    return rows


def table_of_vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "vec_id long, label int, embedding array<float>, cell string, id int, v string").repartition(3)


def as_float32(rows):
    return [(i, lab, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, lab, v in rows]


@pytest.mark.parametrize("cell,block", [(4096, 512), (60, 3)])
def test_hard_negatives(spark, monkeypatch, cell, block):
    monkeypatch.setattr(negatives, "CELL", cell)
    monkeypatch.setattr(negatives, "BLOCK", block)
    rows = vectors(4)
    df = table_of_vectors(spark, rows)
    found = negatives.hard_negatives(negatives.integer_rows(df), F.col("id") % 100 == 0).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert sorted(tuple(r) for r in found.collect()) == mined(as_float32(rows))


def test_hard_negatives_empty_and_large(spark):
    df = table_of_vectors(spark, vectors(5, 20))
    assert negatives.hard_negatives(negatives.integer_rows(df.where("vec_id < 0")), F.col("id") % 100 == 0).count() == 0
    rows = [(i, i % 2, [float(2**20 + i * 2**9), -float(2**21), 1.5]) for i in range(0, 500, 20)]  # products above 2^53
    found = negatives.hard_negatives(negatives.integer_rows(table_of_vectors(spark, rows)), F.col("id") % 100 == 0, low=0, high=110)
    s = {(r.anchor_id, r.negative_id): r.negative_score for r in found.collect()}
    whole = {i: [math.floor(256 * x) for x in v] for i, _, v in rows}
    assert s and all(v == sum(x * y for x, y in zip(whole[a], whole[b], strict=True)) for (a, b), v in s.items())


def test_reach_loses_nothing_and_prunes():
    rng = np.random.default_rng(6)
    v = rng.integers(-500, 500, (300, 6))
    lengths = np.sqrt((v**2).sum(axis=1)).astype(float)
    bucket = negatives.Bucket(v, lengths, np.arange(300), np.zeros(300, np.int64))
    tried = 0
    for a in rng.integers(-500, 500, (50, 6)):
        anchor = negatives.Anchor(a)
        products = v @ a
        for share in (0.3, 0.7, 0.95):
            least = float(products.max()) * share
            got = bucket.reach(anchor, least)
            assert set(np.flatnonzero(products >= least)) <= set(got.tolist())
            tried += len(got)
    assert tried < 50 * 3 * 300 * 0.6


def test_matrix_of_ragged_lists():
    column = pa.chunked_array([pa.array([[1, 2], [], [3]], pa.list_(pa.int64()))])
    assert negatives.matrix(column).tolist() == [[1, 2], [0, 0], [3, 0]]


def test_queries_cover_whole_tables(spark, sf_dir):
    assert katz.op11_katz(spark, sf_dir).count() == documents(spark, sf_dir).count()
