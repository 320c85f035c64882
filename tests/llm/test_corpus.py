"""Corpus operators against brute force, on small tables with nulls, empty and long texts, ties, repeats and
clashing column names."""

import hashlib
import heapq
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from civicspark.llm import bpe, exact, lines, minhash, mixing, ordinal, passages, rules, sharding, toxicity
from civicspark.llm.common import documents, labels

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, size string, n string, run string"
SPACES = " \t\n\x0b\x0c\r"


def table(spark, rows):
    """(doc_id, text, lang, source) with extra columns that clash with inner names."""
    return spark.createDataFrame(
        [(i, t, lang, s, None if t is None else len(t), "x", "y", "z", "w") for i, t, lang, s in rows], SCHEMA).repartition(3)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice("ab cde fghi jk lmnop qrs tuv wxyz ää öü".split()) + rng.choice(["", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    base = prose(1, 120)
    near = base.split(" ")
    near[60] = "changed"
    rows = [
        (1, base, "en", "a"), (2, base.replace(" ", "  "), "en", "a"), (3, " ".join(near), "en", "b"), (4, base.upper(), None, "b"),
        (5, None, "en", None), (6, "", "en", "a"), (7, " \n\t", "de", "c"), (8, "one two", "de", "c"), (8, "one two", "de", "c"),
        (9, "One two", "de", None), (None, "null id text here", "en", "a"), (None, base, "en", "a"),
        (10, "\n".join([prose(5, 30)] * 3), "en", "a"), (11, prose(6, 3000), "en", "a"), (12, "x" * 5000, "fr", "a"), (13, "é" * 30, "fr", "ä")]
    return table(spark, rows), rows


def empty(spark):
    return table(spark, [(1, "a", "en", "a")]).where("doc_id > 1")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# --- exact duplicates -------------------------------------------------------------------------------

def squeezed(t):
    return (t or "").translate({ord(c): None for c in SPACES})


@pytest.mark.parametrize("runs,fan_in", [(1, 2), (7, 2), (64, 8)])
def test_exact_groups(spark, odd, runs, fan_in):
    df, rows = odd
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[squeezed(t)].append((-len(t or ""), i is None, i if i is not None else 0, i))
    out = exact.duplicate_groups(df, runs=runs, fan_in=fan_in).collect()
    assert len(out) == len(rows)
    want = Counter()
    for text, members in groups.items():
        keep = min(members)[3]
        for *_, i in members:
            want[(i, keep, len(members), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out) == want
    assert sum(r.kept for r in out) == len(groups)
    assert all(r.kept <= (r.doc_id == r.keep_id) for r in out)


def test_exact_keep_first(spark, odd):
    df, rows = odd
    kept = exact.keep_first(df)
    assert kept.columns == df.columns
    assert Counter(squeezed(r.text) for r in kept.collect()) == Counter({squeezed(t): 1 for _, t, *_ in rows})
    assert exact.keep_first(empty(spark)).count() == 0
    assert exact.duplicate_groups(empty(spark)).count() == 0


# --- sharding ------------------------------------------------------------------------------------------

def test_heap_takes_the_least_loaded():
    items = [(f"i{k}", random.Random(k).randint(1, 50)) for k in range(200)]
    place = sharding.longest_first(items, 7)
    loads = [(0, s) for s in range(7)]
    for name, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, s = heapq.heappop(loads)
        assert place[name] == s
        heapq.heappush(loads, (load + size, s))


def test_sharding(spark, odd):
    df, rows = odd
    rows = rows + [(100 + k, prose(k, 5 + k % 40), "en", "a") for k in range(400)]
    out = sharding.assign_shards(table(spark, rows), 4).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    loads, slots, homes = Counter(), defaultdict(list), defaultdict(set)
    texts = {(i, zlib.crc32((t or "").encode())): t or "" for i, t, *_ in rows}
    for r in out:
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
        homes[texts[(r.doc_id, r.text_crc32)]].add(r.shard)
    assert all(len(s) == 1 for s in homes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(loads.values()) - min(loads.values()) < 400
    assert sharding.assign_shards(empty(spark), 4).count() == 0


def test_dense_blocks_of_the_classifier_stay_small():
    short = pa.array([f"a few short words {k}" for k in range(3000)])
    tracemalloc.start()
    try:
        ordinal.score_texts(short, np.ones(ordinal.DIMS, np.float32))
        assert tracemalloc.get_traced_memory()[1] < 24 << 20
    finally:
        tracemalloc.stop()


# --- passages --------------------------------------------------------------------------------------------

def test_passages_against_brute_force(spark):
    shared = "This passage of many words stands in several texts. " + " ".join(f"word{k}" for k in range(60)) + ". It ends here with five words."
    rows = [(k, f"{prose(k, 30)}. Intro {k}. {shared} {prose(k + 500, 30)}", "en", "a") for k in range(12)]
    rows += [(20, None, "en", "a"), (21, "", "en", "a"), (22, prose(900, 4000), "en", "a"), (23, "short one.", "en", "a"), (24, "short one.", "en", "a")]
    rows += [rows[3], (None, shared, "en", "a")]
    first = {}
    distinct = sorted(set(r[:2] for r in rows if r[1]), key=lambda r: (r[0] is None, r[0] or 0))
    for i, t in distinct:
        for pos, (a, b, n, d) in enumerate(passages.units(t, "segment", 4)):
            first.setdefault(d, (i, pos))
    want = set()
    for i, t in distinct:
        run = []
        for pos, (a, b, n, d) in [*enumerate(passages.units(t, "segment", 4)), (-9, (0, 0, 0, None))]:
            if run and (d is None or first[d] == (i, pos)):
                if sum(x[2] for x in run) >= 25:
                    want.add((i, run[0][0], run[-1][1]))
                run = []
            if d is not None and first[d] != (i, pos):
                run.append((a, b, n))
    df = table(spark, rows)
    out = passages.repeated_spans(df)
    assert {(r.doc, r.start, r.end) for r in out.collect()} == want
    assert {r.doc for r in out.collect()} == {*range(1, 12), None}
    assert all(r.keep_doc_ids == [0] for r in out.collect())
    left = {r.doc_id: r.text for r in passages.without_repeats(df).collect()}
    assert "word30" in left[0] and "word30" not in left[5] and "Intro 5" in left[5] and left[20] is None
    assert passages.repeated_spans(empty(spark)).count() == 0


def test_repeated_word_runs_against_brute_force(spark):
    rng = random.Random(7)
    fresh = lambda seed, n: " ".join(f"q{seed}x{k}" + ("." if k % 9 == 8 else "") for k in range(n))
    shout = " ".join(rng.choice(["WOW", "BUY", "NOW", "HOT", "TOP"]) + "!!" for _ in range(70))
    inner = fresh("in", 64)
    rows = [(1, f"{fresh(1, 40)} {shout} {fresh(2, 30)}", "en", "a"), (2, f"{fresh(3, 33)} {shout.lower()} {fresh(4, 21)}", "en", "a"),
            (3, f"{fresh(5, 25)} {inner} {fresh(6, 25)}", "en", "a"), (4, f"{fresh(7, 31)} {' '.join(inner.split()[5:57])} {fresh(8, 44)}", "en", "a"),
            (5, "Same " * 60, "en", "a"), (6, "again\n" * 130, "en", "a"), (7, fresh(9, 30) + "\nOne repeated line here\n" + fresh(10, 30), "en", "a"),
            (8, fresh(11, 30) + "\nOne repeated line here\n" + fresh(12, 30), "en", "a"), (None, inner, "en", "a"), (9, None, "en", "a"), (10, "short", "en", "a")]
    rows.append(rows[1])
    first, want = {}, set()
    docs = sorted({r[:2] for r in rows if r[1]}, key=lambda r: (r[0] is None, r[0] or 0))
    for i, t in docs:
        words = [(m.start(), m.end(), m.group().lower()) for m in passages._WORDS.finditer(t)]
        for p in range(len(words) - 49):
            j, q = first.setdefault(tuple(w[2] for w in words[p:p + 50]), (i, p))
            if j != i or p - q >= 50:
                want |= {(i, c) for w in words[p:p + 50] for c in range(w[0], w[1])}
    df = table(spark, rows)
    held = passages.repeated_runs(df.select(F.col("doc_id").alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("raw"), F.coalesce("text", F.lit("")).alias("t")), 50)
    texts = dict(docs)
    got = {(r.doc, c) for r in held.collect() for c in range(r.a, r.b) if passages._WORDS.match(texts[r.doc][c])}
    assert got == want and {i for i, _ in want} == {2, 4, 6, None}
    spans = passages.repeated_spans(df, min_words=1, run_words=50).collect()
    removed = {(r.doc, c) for r in spans for c in range(r.start, r.end)}
    assert want <= removed
    assert [texts[8][r.start:r.end].strip() for r in spans if r.doc == 8] == ["One repeated line here"]
    for r in spans:
        assert r.n_words == len(passages._WORDS.findall(texts[r.doc][r.start:r.end]))
    ends = sorted((str(r.doc), r.start, r.end) for r in spans)
    assert all(x[0] != y[0] or x[2] <= y[1] for x, y in zip(ends, ends[1:], strict=False))


def test_hot_passage_over_many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hot = " ".join(f"hot{k}" for k in range(30))
        df = table(spark, [(k, hot if k % 2 else prose(k, 40), "en", "a") for k in range(400)])
        out = passages.repeated_spans(df, unit="line").collect()
        assert sorted(r.doc for r in out) == list(range(3, 400, 2))
        assert {tuple(r.keep_doc_ids) for r in out} == {(1,)}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_hot_run_over_many_partitions(spark):
    hot = " ".join(f"hot{k}" for k in range(55))
    df = table(spark, [(k, f"start{k} {hot} end{k}", "en", "a") for k in range(300)] + [(None, hot, "en", "a")])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        out = passages.repeated_spans(df, min_words=1, run_words=50).collect()
        assert sorted(r.doc or 300 for r in out) == list(range(1, 301))
        assert all(r.keep_doc_ids == [0] and r.n_words == 55 for r in out)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_open_rows_are_settled_by_a_join_of_all_rows(spark):
    """The rows of a common key over many partitions make no join larger than its input."""
    df = table(spark, [(k, prose(k % 7, 70), "en", "a") for k in range(60)])
    plan = passages.repeated_spans(df, min_words=1, run_words=50)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 2 and "Join Inner" not in plan


@pytest.mark.parametrize("size", [1, 3, 100])
def test_repeats_of_batches_of_any_size(size):
    rows = [(k, 1, doc, 5, pos, 0, 9, 0, 4) for k in (3, 4, 9) for doc, pos in ((1, 0), (1, 0), (1, 2), (2, 0), (None, 1), (None, 1))]
    batches = pa.table(dict(zip(["h1", "h2", "doc", "raw", "pos", "a", "b", "w", "words"], zip(*rows, strict=True), strict=True))).to_batches(max_chunksize=size)
    got = [tuple(r.values()) for b in passages._repeats(iter(batches)) for r in b.to_pylist()]
    want = [(*rows[i], None, True) for i in (0, 2, 3, 4)] + [(None, None, *rows[i][2:], 1, False) for k in (6, 12) for i in (k + 2, k + 3, k + 4)]
    assert got == [*want, (9, 1, 1, 5, 0, 0, 9, 0, 0, None, True)]


# --- lines -----------------------------------------------------------------------------------------------

def kept_by_brute_force(rows, least=20, docs=3):
    holders = defaultdict(set)
    key = lambda line: lines.line_key(line.encode()).decode()
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(i)
    out = Counter()
    for i, t, *_ in rows:
        parts = (t or "").split("\n")
        stay = [p for p in parts if len(holders[key(p)]) < docs or max(holders[key(p)], key=lambda x: -1 if x is None else x) == i]
        out[(i, len(parts), len(parts) - len(stay), "\n".join(stay))] += 1
    return out


def test_lines(spark, odd):
    _, rows = odd
    common = "  A line that MANY documents share\t"
    rows = rows + [(200 + k, f"{prose(k, 10)}\n{common if k % 2 else common.strip().lower()}\n{prose(k, 4)}\n{common}", "en", "a") for k in range(60)]
    rows += [(300, "é" * 19 + "\n" + "ü" * 20, "en", "a"), (301, "é" * 19 + "\n" + "ü" * 20, "en", "a"), (302, "é" * 19 + "\n" + "ü" * 20, "en", "a"), rows[-1]]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = lines.without_common_lines(table(spark, rows))
        assert Counter(tuple(r) for r in out.collect()) == kept_by_brute_force(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert lines.without_common_lines(empty(spark)).count() == 0


def test_bitmaps_are_compressed_and_partial(spark):
    rows = [(k, "a line of more than twenty points\n" * 50 + str(k), "en", "a") for k in range(3)]
    maps = lines.keep_bitmaps(table(spark, rows)).collect()
    assert sorted(m.doc for m in maps) == [0, 1] and all(len(m.keep) < 30 for m in maps)


# --- BPE ---------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def reference_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


HARD = ["", " ", "a" * 3000, "ab" * 1500, "the" * 900, " " * 500 + "x", "\n \n  \t" * 200, "<|endoftext|>" * 60, "x<|endo" + "ftext|>" * 20,
        "it's we'll they've I'd " * 80, "'" * 300 + "s'll've", "äöü€😀" * 200, "1234567890" * 90, "!!!???" * 200, "foo  bar\r\n\tbaz " * 90,
        "‍́" * 200, "日本語のテキスト" * 100, "don't<|endoftext|> 're  " * 70]


def test_join_is_exact_at_every_cut(reference_tokenizer):
    path = bpe.vocabulary_path()
    rng = random.Random(3)
    texts = HARD + ["".join(rng.choice(HARD[2:])[:rng.randint(1, 60)] for _ in range(12)) for _ in range(150)]
    for text in texts:
        want = reference_tokenizer.encode(text, add_special_tokens=False).ids
        for _ in range(4):
            cut = rng.randint(0, len(text))
            halves = [bpe.encode_text(t, path) for t in (text[:cut], text[cut:])]
            assert bpe.join_halves(*halves, path, window=2).tolist() == want, (text[:80], cut)


def test_tree_of_long_texts(spark, reference_tokenizer):
    rows = [(k, t, "en", "a") for k, t in enumerate(HARD)] + [(90, None, "en", "a"), (2, HARD[2], "en", "a"), (None, prose(3, 900), "en", "a")]
    tokens = bpe.encoded(table(spark, rows), leaf=97)
    got = Counter((r.doc_id, bytes(r.ids), r.text) for r in bpe.decoded(tokens).collect())
    want = Counter()
    for i, t, *_ in rows:
        ids = reference_tokenizer.encode(t or "", add_special_tokens=False).ids
        want[(i, np.array(ids, "<u4").tobytes(), reference_tokenizer.decode(ids, skip_special_tokens=False))] += 1
    assert got == want
    assert bpe.encoded(empty(spark)).count() == 0


def test_bpe_on_documents(spark, sf_dir, reference_tokenizer):
    out = {r.doc_id: r for r in bpe.op2_bpe(spark, sf_dir).collect()}
    rows = documents(spark, sf_dir).select("doc_id", "text").collect()
    assert len(out) == len(rows)
    for r in rows:
        ids = reference_tokenizer.encode(r.text or "", add_special_tokens=False).ids
        assert out[r.doc_id].n_tokens == len(ids)
        assert out[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert out[r.doc_id].decoded_sha256 == hashlib.sha256(reference_tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# --- MinHash -----------------------------------------------------------------------------------------------

def shingle_set(t):
    words = "".join(c.lower() if c.isascii() else c for c in t or "").translate({ord(c): " " for c in SPACES}).split(" ")
    words = [w for w in words if w]
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def near_by_brute_force(rows):
    sets = [(i, shingle_set(t)) for i, t, *_ in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if (sets[x][0] is not None and sets[x][0] == sets[y][0]) or (a and b and 100 * len(a & b) >= 75 * len(a | b)):
                parent[root(x)] = root(y)
    label = defaultdict(list)
    for x, (i, _) in enumerate(sets):
        if i is not None:
            label[root(x)].append(i)
    return Counter((i, len(s), i if not s and i is not None else min(label[root(x)], default=None)) for x, (i, s) in enumerate(sets))


def test_near_duplicates(spark, odd):
    _, rows = odd
    rng = random.Random(9)
    base = [prose(100 + k, 90).split(" ") for k in range(12)]
    for k in range(150):  # chains and groups around the threshold
        words = list(base[k % 12])
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"w{rng.randint(0, 5)}"
        rows = rows + [(500 + k, " ".join(words), "en", "a")]
    out = minhash.near_duplicates(table(spark, rows)).collect()
    assert Counter((r.id, r.n_shingles, r.component_id) for r in out) == near_by_brute_force(rows)


def test_near_duplicates_on_documents(spark, sf_dir):
    rows = [tuple(r) for r in documents(spark, sf_dir).select("doc_id", "text").collect()]
    out = minhash.op9_minhash(spark, sf_dir).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == near_by_brute_force(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_keep_one(spark, odd):
    df, rows = odd
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and 3 not in ids and 5 in ids and 6 in ids and ids.count(8) == 1
    assert minhash.keep_one(empty(spark)).count() == 0


def test_signature_is_two_permutations():
    first, shifts = minhash.permutations()
    hashes = np.arange(1, 40, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    second = shifts[:, 0]
    places = first[(hashes % np.uint64(minhash.PLACES)).astype(np.int64)].astype(np.int64)
    want = [second[(places + k) % minhash.PLACES].min() for k in range(minhash.K)]
    assert minhash.signature(hashes).tolist() == want


# --- mixing ------------------------------------------------------------------------------------------------

def words(t):
    return len([w for w in (t or "").translate({ord(c): " " for c in SPACES}).split(" ") if w])


def targets_by_hand(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    want, full = 1.5 * sum(sizes.values()), set()
    while True:
        left = want - sum(2 * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        t = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_} if open_ else {}
        above = {s for s in t if t[s] > 2 * sizes[s]}
        if not above:
            return {**{s: 2 * sizes[s] for s in full}, **t}
        full |= above


def test_mixing_plan(spark):
    rows = [(k, prose(k, 1 + k * 7 % 90), "en", [None, "a", "b", "ä", "z", "Z"][k % 6 if k % 2 else 1]) for k in range(600)]
    rows += [(900, None, "en", "a"), (901, "", "en", "only empty"), (5, rows[5][1], "en", rows[5][3]), (None, "a b c", "en", "b")]
    df = table(spark, rows)
    out = mixing.mixing_plan(df).collect()
    assert len(out) == len(rows)
    sizes, taken = Counter(), Counter()
    for _, t, _, s in rows:
        sizes[s] += words(t)
    want = targets_by_hand(sizes)
    for r in out:
        taken[r.source] += r.taken
        assert r.taken <= 2 * r.size and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert r.taken == r.whole * r.size + r.head + r.tail
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1, (s, taken[s], t)
    again = mixing.mixing_plan(df.repartition(7)).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))
    assert mixing.mixing_plan(empty(spark)).count() == 0
    docs = mixing.mixed_documents(df)
    assert docs.columns == df.columns
    mixed = Counter()
    for r in docs.collect():
        mixed[r.source] += words(r.text)
        assert r.n_chars == len(r.text)
    assert mixed == Counter({s: n for s, n in taken.items() if n})


def test_tiny_sources_are_not_lost(spark):
    sizes = {f"tiny{k}": 1 + k % 5 for k in range(20)}
    rows = [(k, prose(k, n), "en", s) for k, (s, n) in enumerate(sizes.items())]
    rows += [(100 + k, prose(k, 400), "en", "vast") for k in range(30)] + [(200 + k, "one", "en", "words") for k in range(9)]
    sizes |= {"vast": 30 * 400, "words": 9}
    want = targets_by_hand(sizes)
    taken = Counter()
    for r in mixing.mixing_plan(table(spark, rows)).collect():
        taken[r.source] += r.taken
        assert r.taken <= 2 * r.size
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1 and taken[s] >= min(t, 1), (s, taken[s], t)


def test_very_many_sources(spark):
    """A list of 100,000 sources, all rounded the same way, lists few seats to rank."""
    parties = spark.range(100_000).select(F.format_string("s%06d", "id").alias("p"), (F.lit(2.5) + F.col("id") % 2).alias("v"), F.lit(10**6).alias("most"))
    for seats in (300_000, 299_990, 250_000, 345_678):
        got = mixing.apportion(parties.withColumn("house", F.lit(seats)), [], "v", "house", "most", ["p"])
        q = F.col("quota")
        r = got.groupBy().agg(F.sum(q).alias("q"), F.min(F.when(q > 0, F.col("v") / (2 * q - 1))).alias("won"), F.max(F.col("v") / (2 * q + 1)).alias("lost")).first()
        assert r.q == seats and r.lost <= r.won  # no seat lost has a higher quotient than one won


def test_apportionment_by_highest_quotients(spark):
    rng = random.Random(5)
    for trial in range(10):
        votes = [(f"p{k}", rng.choice([0, rng.randint(1, 1000), 400]), rng.choice([3, 10**6])) for k in range(rng.randint(1, 30))]
        seats = rng.randint(0, 80)
        df = spark.createDataFrame(votes, "p string, v long, most long").withColumn("house", F.lit(seats))
        got = {r.p: r.quota for r in mixing.apportion(df, [], "v", "house", "most", ["p"]).collect()}
        lots = sorted((-v / (2 * k + 1), p, k) for p, v, most in votes if v for k in range(min(most, seats)))[:seats]
        assert got == {p: sum(x[1] == p for x in lots) for p, *_ in votes}, trial


# --- rules --------------------------------------------------------------------------------------------------

def rule_counts(t):
    t = t or ""
    w = [x for x in t.translate({ord(c): " " for c in SPACES}).split(" ") if x]
    seen = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    twice = {i + j for i in range(len(w) - 4) if seen[tuple(w[i:i + 5])] > 1 for j in range(5)}
    full = [x for x in t.split("\n") if x.strip(SPACES)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for x in w for c in x), len(full) - len(set(full)), len(twice)


def test_rules(spark, odd):
    _, rows = odd
    rows = rows + [(30, "a b c d e a b c d e a b", "en", "a"), (31, "x y z w v u # $ x y z w v q r s t\nq\nq", "en", "a")]
    marks = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (999, 1), (None, 1)], "doc_id long, quality int")
    out = rules.judge(table(spark, rows), marks).collect()
    assert Counter(tuple(r)[:6] for r in out) == Counter((i, *rule_counts(t)) for i, t, *_ in rows)
    for r in out:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed)  # too few ratings to certify anything
    assert rules.judge(empty(spark), marks).count() == 0


def test_binomial_tail(spark):
    from math import comb

    cases = [(n, k) for n in (1, 5, 40, 300) for k in (0, 1, 3, 7) if k <= n * 0.3]
    df = spark.createDataFrame(cases, "n long, k long").withColumn("p", rules.binomial_tail(F.col("n"), F.col("k"), 0.3))
    for r in df.collect():
        assert r.p == pytest.approx(sum(comb(r.n, i) * 0.3**i * 0.7**(r.n - i) for i in range(r.k + 1)), rel=1e-9)


def test_cutoffs_hold_their_risk(spark):
    rng = random.Random(1)
    rows, marks = [], []
    for k in range(3000):
        words_ = prose(k, 40).replace(",", "").split(" ")
        good = k % 3 != 0
        for j in range(rng.randint(0, 1) if good else 12):
            words_[j] += "##"
        rows.append((k, " ".join(f"{w}{i}" for i, w in enumerate(words_)), "en", "a"))
        marks.append((k, int(good)))
    out = rules.judge(table(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int")).collect()
    fell = [r.doc_id for r in out if not r.kept]
    assert sum(k % 3 == 0 for k in fell) == 1000
    assert sum(k % 3 != 0 for k in fell) <= rules.ALPHA * 2000


# --- classifiers ---------------------------------------------------------------------------------------------

def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5)).astype(np.float32)
    eta = x @ np.array([2, -1, 0, 0, 1.0]) + rng.logistic(size=600) * 0.3
    model = ordinal.fit(x, np.digitize(eta, [-1, 1.5]), 3)
    assert model.thresholds[0] < model.thresholds[1]
    score = x @ model.weights
    assert np.corrcoef(score, eta)[0, 1] > 0.95
    assert np.mean(np.digitize(score, model.thresholds) == np.digitize(eta, [-1, 1.5])) > 0.85


def test_quality_held_out(spark, sf_dir):
    docs, marks = documents(spark, sf_dir.replace("0.001", "0.01")), labels(spark, sf_dir.replace("0.001", "0.01"))
    train = marks.where("doc_id % 2 = 0")
    out = ordinal.graded(docs, ordinal.ratings_of(train)).select("doc.doc_id", "kept", "expected_grade").join(marks.where("doc_id % 2 = 1"), "doc_id").collect()
    right = [r.kept == (r.quality == 1) for r in out]
    assert np.mean(right) > 0.95
    assert np.mean([r.kept for r in out if r.quality == 1]) > 0.98


def test_quality_odd_cases(spark, odd):
    df, rows = odd
    none = spark.createDataFrame([(1, None), (None, 2)], "r_id long, grade int")
    out = ordinal.graded(df, none)
    assert out.select("doc.*").columns == df.columns
    assert all(r.kept and 0 <= r.expected_grade <= 2 for r in out.collect()) and out.count() == len(rows)
    assert ordinal.graded(empty(spark), none).count() == 0


def test_features_do_not_depend_on_neighbours():
    texts = [b"One two two three!", b"", b"### $$$ CAPS", "äöü".encode(), b"x"]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = np.frombuffer(b"".join(texts), np.uint8)
    both = ordinal.text_features(data, offsets)
    for i, t in enumerate(texts):
        alone = ordinal.text_features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert np.allclose(both[i], alone[0])


def test_toxicity_held_out(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.1")
    out = toxicity.op6_toxicity(spark, sf)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    known = out.join(labels(spark, sf), "doc_id").where("held_out").toPandas()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in known.itertuples())
    pos, neg = known[known.toxic == 1].score.values, known[known.toxic == 0].score.values
    assert (pos[:, None] > neg[None, :]).mean() > 0.93
    assert (neg >= 0.7).mean() < 0.03 and (pos >= 0.7).mean() > 0.7


def test_toxicity_learns_many_words_and_patterns():
    # 600 rare insults of three rows each: more than any fixed list of voters or features would hold
    rng = np.random.default_rng(5)
    plain = rng.integers(10**6, 10**6 + 500, (9000, 12))
    rude = np.repeat(np.arange(600), 3)
    rows = np.concatenate([np.repeat(np.arange(9000), 12), np.arange(1800)])
    words = np.concatenate([plain.ravel(), rude])
    mark = np.arange(9000) < 1800
    assert len(toxicity._voters(rows, words, mark)) > 600
    spelling = np.zeros((9000, 4), np.uint8)
    spelling[1800:2100, 1] = 1  # marked by a pattern alone
    q = np.where(np.arange(9000) < 2100, 0.98, 0.02)
    model = toxicity.linear(rows, words, spelling, q, 0.0025)
    assert len(set(model.weights) & set(range(600))) == 600 and min(model.weights[w] for w in range(600)) > 0
    assert model.spelling[1] > 2


def test_toxicity_scores_patterns(spark):
    model = toxicity.ToxicityModel({}, -2.0, (0.0, 4.0, 0.0, 0.0))
    df = spark.createDataFrame([("you id*ot and so on for long",), ("nothing of the kind in here",), (None,)], "t string")
    got = [r.s for r in df.select(toxicity.scored(F.col("t"), model).alias("s")).collect()]
    assert got[0] > 0.85 and got[1] < 0.15 and got[2] < 0.15


def test_toxicity_ignores_held_out_labels(spark):
    ids = list(range(60))
    rows = [(i, f"{prose(i, 12)} {'zonk' if i % 2 else 'fine'}", "en", "a") for i in ids]
    out = [zlib.crc32(str(i).encode()) % 3 == 1 for i in ids]
    marks = [(i, int(i % 2)) for i in ids]
    flipped = [(i, int(i % 2) if not out[i] else 1 - i % 2) for i in ids]
    a, b = (toxicity.train(table(spark, rows), spark.createDataFrame(m, "doc_id long, toxic int")) for m in (marks, flipped))
    assert a == b


def test_toxicity_odd_cases(spark, odd):
    df, rows = odd
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(df, none)
    out = df.select(toxicity.scored(F.col("text"), model).alias("s")).collect()
    assert len(out) == len(rows) and all(0 <= r.s <= 1 for r in out)
    assert empty(spark).select(toxicity.scored(F.col("text"), model)).count() == 0


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(2)
    y = rng.random(4000) < 0.2
    good = rng.random((4000, 4)) < np.where(y[:, None], 0.6, 0.02)
    noise = rng.random((4000, 2)) < 0.3
    quiet = good.max(axis=1) == 0
    votes = np.column_stack([good, noise, quiet]).astype(np.int8)
    q, say, ties = toxicity.label_model(votes, 0.02 + 0.96 * ~quiet, 0.2)
    assert np.mean((q > 0.5) == y) > 0.9
    assert (say[:4] > 2).all() and (np.abs(say[4:6]) < 0.5).all()


def test_quality_scores_short_rows_in_bounded_memory():
    import tracemalloc

    texts = pa.array([f"short row number {i} of many" for i in range(10_000)])
    weights = np.linspace(-1, 1, ordinal.DIMS).astype(np.float32)
    tracemalloc.start()
    scores = ordinal.score_texts(texts, weights)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20
    one_by_one = [float(ordinal.score_texts(texts.slice(i, 1), weights)[0]) for i in (0, 511, 512, 9_999)]
    assert scores[[0, 511, 512, 9_999]].tolist() == pytest.approx(one_by_one, abs=1e-5)


# --- pipeline --------------------------------------------------------------------------------------------------

def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as p

    docs = documents(spark, sf_dir)
    columns = docs.columns
    counts = []
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns, name
        counts.append(docs.count())
        if name == "exact dedup":
            texts = [squeezed(r.text) for r in docs.collect()]
            assert len(texts) == len(set(texts))
        if name == "MinHash near-dedup":
            rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
            assert all(c == i for i, _, c in near_by_brute_force(rows))
    last = p.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == counts[-1]
    assert counts[0] >= counts[1] >= counts[2] > 0
    assert Counter(r.decoded_sha256 for r in last.collect()) == Counter(hashlib.sha256(r.text.encode()).hexdigest() for r in docs.collect())


def test_minhash_null_id_beside_a_near_duplicate(spark):
    base = " ".join(f"w{k}" for k in range(150))
    near = base.replace("w75 ", "changed ")
    rows = [(2, near, "en", "a"), (5, base, "en", "a"), *[(None, base.replace(" ", " " * k), "en", "a") for k in range(2, 6)], (None, base.upper(), "en", "a")]
    found = {r.id: r.component_id for r in minhash.near_duplicates(table(spark, rows)).collect() if r.id is not None}
    assert found == {2: 2, 5: 2}


def test_minhash_large_sets_at_the_line():
    both = next(b for b in range(700_000, 1_500_000) if b % 3 == 0 and int(np.float32(100 * b)) < 100 * b)
    sets = [np.arange(both), np.arange(both * 4 // 3)]  # similarity exactly 0.75
    shingles = pa.ListArray.from_arrays(pa.array([0, len(sets[0]), len(sets[0]) + len(sets[1])], pa.int32()), pa.array(np.concatenate(sets)))
    block = pa.table({"id": pa.array([1, 2]), "label": pa.array([1, 2]), "shingles": shingles})
    assert minhash._links_in_block(75)(block).to_pylist() == [{"a": 1, "b": 2}]
