"""Near-duplicates by circulant MinHash, banding and exact verification.

1. Shingles are the distinct windows of five words (64-bit hashes). Rows with equal sets collapse to one
   node (their smallest id), so copies never meet each other again.
2. Signatures: a first permutation of 2^22 places shuffles the shingles, a second one is read at K
   circular shifts; coordinate k is the smallest value of the second permutation, shifted by k, over the
   set. Two permutations thus give all K = 128 coordinates. 32 bands of 4 miss a pair at similarity
   0.75 with probability 5e-6.
3. Links: in each bucket every node is compared with the smallest one (a star, never all pairs), the
   links that hold are joined to components, and only pairs of one bucket that are still in different
   components are compared afterwards. So every candidate pair is either compared or already known to be
   connected. Pairs whose signatures agree in far too few places (5.7 standard deviations below) or whose
   sizes rule out the similarity are not compared. A bucket of more than 32 is compared in blocks: a task gets
   the full sets of at most two blocks, counts all overlaps by a matrix product and returns only links
   that join components, so no list of pairs arises. Small sets meet by the rarest of their
   shingles instead, an exact prefix filter, since a common line alone fills their buckets.
4. Verification reads both whole texts and compares the full sets: 100 * intersection >= 75 * union.
5. Components: smallest labels spread along the links, with pointer jumping, until nothing changes;
   every round is a written table. No list of links or nodes reaches the driver.

Defined cases: a null text and a text without words have no shingles and link with nothing; texts of
fewer than five words have one shingle, all their words; rows with the same id are one document; a null id
takes the component of an equal set that has ids, else it has component null and is kept; extra
columns are ignored or, by :func:`keep_one`, returned.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.llm.common import U64, body, documents, hashed_words, mixed, slices, text_buffers
from civicspark.session import settled

WORDS = 5
PLACES = 1 << 22
BANDS, ROWS = 32, 4
K = BANDS * ROWS
CHUNK = 1 << 20
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], U64)


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word windows (with repeats) and their rows, in order."""
    hashes, rows = hashed_words(data, offsets)
    n = np.bincount(rows, minlength=len(offsets) - 1)
    if not len(hashes):
        return hashes, rows
    size = len(hashes)
    padded = np.concatenate([hashes, np.zeros(words, U64)])
    ends = np.cumsum(n)[rows]
    left = ends - np.arange(size)  # words of the row from here on
    total = np.zeros(size, U64)
    for j in range(words):
        total += np.where(left > j, padded[j:j + size] * _STEPS[j], U64(0))
    first = np.arange(size) == ends - n[rows]
    valid = (left >= words) | (first & (n[rows] < words))
    total = mixed(total + np.minimum(n[rows], words).astype(U64))
    return total[valid], rows[valid]


@functools.lru_cache(maxsize=1)
def permutations() -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and the second one as its K circular shifts (a view, row i = places i to i + K)."""
    rng = np.random.Generator(np.random.PCG64(20210609))
    first = rng.permutation(PLACES).astype(np.uint32)
    second = rng.permutation(PLACES).astype(np.uint32)
    return first, np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[:K - 1]]), K)


def signature(hashes: np.ndarray) -> np.ndarray:
    first, shifts = permutations()
    places = first[(hashes & U64(PLACES - 1)).astype(np.int64)]
    out = np.full(K, PLACES, np.uint32)
    for i in range(0, len(places), 8192):
        np.minimum(out, shifts[places[i:i + 8192]].min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, unlike those of other bands."""
    rows = sig.reshape(BANDS, ROWS).astype(U64)
    h = np.arange(1, BANDS + 1, dtype=U64) * _STEPS[0]
    for j in range(ROWS):
        h = mixed(h + rows[:, j] * _STEPS[j + 1])
    return h.view(np.int64)


def sketch(sig: np.ndarray) -> np.ndarray:
    """Four bits of every coordinate, in K / 16 numbers."""
    bits = (mixed(sig.astype(U64)) & U64(15)).reshape(-1, 16)
    return np.bitwise_or.reduce(bits << (np.arange(16, dtype=U64) * U64(4)), axis=1).view(np.int64)


SMALL = 64
_SET = "id long, raw long, n long, node binary, bands array<long>, sketch array<long>, few array<long>"


def _sets(batches):
    for batch in batches:
        data, offsets = text_buffers(batch.column("t"))
        for lo, hi in slices(offsets, CHUNK):
            base = offsets[lo]
            hashes, rows = shingles(data[base:offsets[hi]], offsets[lo:hi + 1] - base)
            cuts = np.searchsorted(rows, np.arange(hi - lo + 1))
            n, node, bands, sketches, few = [], [], [], [], []
            for i in range(hi - lo):
                own = np.unique(hashes[cuts[i]:cuts[i + 1]])
                n.append(len(own))
                few.append(own.view(np.int64) if len(own) <= SMALL else np.zeros(0, np.int64))
                if len(own):
                    sig = signature(own)
                    node.append(xxhash.xxh3_128_digest(own.tobytes()))
                    bands.append(band_keys(sig))
                    sketches.append(sketch(sig))
                else:
                    node.append(None)
                    bands.append(np.zeros(0, np.int64))
                    sketches.append(np.zeros(0, np.int64))
            ids = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays(
                [ids.column("id"), ids.column("raw"), pa.array(n, pa.int64()), pa.array(node, pa.binary()),
                 _lists(bands), _lists(sketches), _lists(few)], names=["id", "raw", "n", "node", "bands", "sketch", "few"])


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate(rows) if rows else np.zeros(0, np.int64))


def shingle_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    t = body(text_col)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(t).alias("raw"), t.alias("t")).mapInArrow(_sets, _SET)


def _verify(percent: int):
    def rows(batches):
        for batch in batches:
            kept = []
            sides = [text_buffers(batch.column(c)) for c in ("a_t", "b_t")]
            for i in range(batch.num_rows):
                sets = []
                for data, offsets in sides:
                    part = data[offsets[i]:offsets[i + 1]]
                    sets.append(np.unique(shingles(part, np.array([0, len(part)]))[0]))
                both = len(np.intersect1d(*sets, assume_unique=True))
                kept.append(both > 0 and 100 * both >= percent * (len(sets[0]) + len(sets[1]) - both))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return rows


def _agreeing(a: str, b: str):
    """How many coordinates of two sketches agree (random ones agree in one of 16)."""
    low = F.lit(0x1111111111111111)
    total = F.lit(0)
    for i in range(K // 16):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        total = total + F.bit_count(x.bitwiseAND(low))
    return F.lit(K) - total


LEAST_AGREEING = 70  # at similarity 0.75, 98 agree on average, with a standard deviation of less than 4.9


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) for all nodes of ``links`` (a, b)."""
    both = settled(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = settled(both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near, F.col("node") == F.col("a"), "left").select(
            "node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("j"), F.col("label").alias("further"))
        step = step.join(jump, F.col("label") == F.col("j"), "left").select("node", "was", F.least("label", "further").alias("label"))
        step = settled(step, "labels")
        labels = step.select("node", "label")
        if step.where("was <> label").isEmpty():
            return labels


PAIRWISE = 32  # larger buckets are compared in blocks; the outcome is the same
BLOCK = 512


def _full_sets(batches):
    for batch in batches:
        data, offsets = text_buffers(batch.column("t"))
        sets = [np.unique(shingles(data[a:b], np.array([0, b - a]))[0]).view(np.int64) for a, b in zip(offsets, offsets[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), _lists(sets)], names=["s_id", "shingles"])


def overlaps(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many elements the sets (concatenated in ``flat``) share, pair by pair; elements that only one
    set has are left out before the product."""
    _, code, often = np.unique(flat, return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    shared = often[code] > 1
    rows, code = rows[shared], np.cumsum(often > 1)[code[shared]] - 1
    total = np.zeros((len(sizes), len(sizes)), np.int64)
    order = np.argsort(code, kind="stable")
    rows, code = rows[order], code[order]
    width = 1024
    for start in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        lo, hi = np.searchsorted(code, [start, start + width])
        x = np.zeros((len(sizes), width), np.float32)
        x[rows[lo:hi], code[lo:hi] - start] = 1
        total += (x @ x.T).astype(np.int64)  # at most width, exact
    return total


def _links_in_block(percent: int):
    """Links of one block that join different labels, no more than are needed to join them."""

    def links(table: pa.Table) -> pa.Table:
        ids, label = table.column("id").to_numpy(), table.column("label").to_numpy()
        lists = table.column("shingles").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        sizes = np.diff(lists.offsets.to_numpy())
        both = overlaps(lists.flatten().to_numpy(), sizes)
        holds = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
        names, root = np.unique(label, return_inverse=True)
        a, b = [], []
        todo = np.ones(len(names), bool)
        member = [np.flatnonzero(root == k) for k in range(len(names))]
        for k in range(len(names)):  # breadth first over labels
            queue = [k] if todo[k] else []
            todo[k] = False
            while queue:
                own = member[queue.pop()]
                reach = holds[own]
                for v in np.flatnonzero(reach.any(axis=0)):
                    if todo[root[v]]:
                        todo[root[v]] = False
                        queue.append(root[v])
                        u = own[np.argmax(reach[:, v])]
                        a.append(min(ids[u], ids[v]))
                        b.append(max(ids[u], ids[v]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return links


def _small_pairs(short: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of small sets (id, n, label, few) that can hold and have different labels.

    Sets of n and s elements that hold share at least need = ceil(percent * (n + s) / (100 + percent)) of
    them, hence one of the first n - need + 1 and s - need + 1 in any common order. With the rarest first,
    what most texts share is not among them, so the sets of one hot bucket do not meet."""
    each = short.select("id", F.explode("few").alias("s"))
    rare = each.join(each.groupBy("s").agg(F.count(F.lit(1)).alias("df")), "s")
    ranked = rare.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("ranked"))  # SMALL at most
    sized = short.select("id", "n", "label").join(ranked, "id").select("*", F.explode(F.sequence(
        F.ceil(F.col("n") * percent / 100).cast("long"), F.floor(F.col("n") * 100 / percent).cast("long"))).alias("m"))
    need = F.ceil((F.col("n") + F.col("m")) * percent / (100 + percent)).cast("int")
    keyed = sized.select("id", "n", "m", "label", F.explode(F.slice("ranked", F.lit(1), F.greatest(F.lit(0), F.col("n").cast("int") - need + 1))).alias("r"))
    keyed = settled(keyed.select("id", "n", "m", "label", F.col("r.s").alias("s")), "small-keys")
    x, y = (keyed.select(*[F.col(c).alias(f"{side}_{c}") for c in keyed.columns]) for side in "xy")
    met = x.join(y, (F.col("x_s") == F.col("y_s")) & (F.col("x_n") == F.col("y_m")) & (F.col("x_m") == F.col("y_n"))
                 & (F.col("x_id") < F.col("y_id")) & (F.col("x_label") != F.col("y_label")))
    return met.select(F.col("x_id").alias("a"), F.col("y_id").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row per row of ``docs``: id, raw (hash of the text), n_shingles, component_id."""
    rows = settled(shingle_sets(docs, id_col, text_col), "shingle-sets")
    nodes = rows.where("n > 0").groupBy("node").agg(
        F.min("id").alias("id"), F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "raw")).alias("rep"), F.first("n").alias("n"),
        F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("few").alias("few")).where("id is not null")
    nodes = settled(nodes.select("node", "id", F.col("rep.raw").alias("raw"), "n", "bands", "sketch", "few"), "nodes")
    buckets = nodes.select("id", "n", F.explode("bands").alias("bucket"))
    heads = buckets.groupBy("bucket").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = settled(buckets.join(heads, "bucket").select("bucket", "id", "n", "head"), "buckets")
    facts = nodes.select("id", "n", "sketch")

    def checked(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that hold, by their full sets."""
        x, y = facts.select(*[F.col(c).alias(f"x_{c}") for c in facts.columns]), facts.select(*[F.col(c).alias(f"y_{c}") for c in facts.columns])
        near = pairs.distinct().join(x, F.col("a") == F.col("x_id")).join(y, F.col("b") == F.col("y_id"))
        near = near.where((100 * F.least("x_n", "y_n") >= percent * F.greatest("x_n", "y_n"))
                          & (_agreeing("x_sketch", "y_sketch") >= LEAST_AGREEING)).select("a", "b")
        near = settled(near, "pairs")
        wanted = near.select(F.col("a").alias("id")).unionByName(near.select(F.col("b").alias("id"))).distinct()
        texts = settled(texts_of(wanted), "texts").select("id", "t")
        pair = near.join(texts.withColumnsRenamed({"id": "i", "t": "a_t"}), F.col("a") == F.col("i")).drop("i")
        pair = pair.join(texts.withColumnsRenamed({"id": "i", "t": "b_t"}), F.col("b") == F.col("i"))
        return settled(pair.select("a", "b", "a_t", "b_t").mapInArrow(_verify(percent), "a long, b long"), "links")

    def texts_of(wanted: DataFrame) -> DataFrame:
        wanted = wanted.join(nodes.select("id", "raw"), "id").select(F.col("id").alias("w_id"), F.col("raw").alias("w_raw"))
        t = body(text_col)
        texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(t).alias("raw"), t.alias("t"))
        texts = texts.join(wanted.hint("shuffle_hash"), (F.col("id") == F.col("w_id")) & (F.col("raw") == F.col("w_raw")), "left_semi")
        return texts.select("id", "raw", "t").dropDuplicates(["id", "raw"])

    def in_blocks(crowded: DataFrame) -> DataFrame:
        sets = texts_of(crowded.select("id").distinct()).select("id", "t").mapInArrow(_full_sets, "s_id long, shingles array<long>")
        blocks = F.ceil(F.col("size") / BLOCK).cast("int")
        dealt = crowded.select("bucket", "id", "label", blocks.alias("blocks"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("own"))
        dealt = dealt.select("bucket", "id", "label", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
        dealt = dealt.select("bucket", F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi"), "id", "label")
        met = dealt.join(settled(sets, "crowded-sets"), F.col("id") == F.col("s_id")).drop("s_id")
        return met.groupBy("bucket", "lo", "hi").applyInArrow(_links_in_block(percent), "a long, b long")

    links = checked(members.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")))
    labels = components(links)
    told = members.join(labels, F.col("id") == F.col("node"), "left").select("bucket", "id", "n", "head", F.coalesce("label", "id").alias("label"))
    mixed_up = told.groupBy("bucket").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("bucket")
    open_ = settled(told.join(mixed_up, "bucket").where("id <> head").join(facts.select(F.col("id").alias("f"), "sketch"), F.col("id") == F.col("f")).drop("f", "head"), "open-buckets")
    large = open_.where(100 * F.col("n") > percent * SMALL)  # those that may meet a set of more than SMALL
    counts = large.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    large = settled(large.join(counts, "bucket"), "large-members")
    lean = large.where(F.col("size") <= PAIRWISE)
    other = lean.select(*[F.col(c).alias(f"o_{c}") for c in lean.columns])
    rest = lean.join(other, (F.col("bucket") == F.col("o_bucket")) & (F.col("id") < F.col("o_id")) & (F.col("label") != F.col("o_label"))
                     & (F.greatest("n", "o_n") > SMALL) & (100 * F.least("n", "o_n") >= percent * F.greatest("n", "o_n"))
                     & (_agreeing("sketch", "o_sketch") >= LEAST_AGREEING))
    short = open_.where(F.col("n") <= SMALL).select("id", "n", "label").distinct()
    short = short.join(nodes.select(F.col("id").alias("f"), "few"), F.col("id") == F.col("f")).drop("f")
    more = checked(rest.select(F.col("id").alias("a"), F.col("o_id").alias("b")).unionByName(_small_pairs(short, percent)))
    more = settled(more.unionByName(in_blocks(large.where(F.col("size") > PAIRWISE))), "more-links")
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    named = nodes.select(F.col("node").alias("g_node"), F.col("id").alias("g_id"))
    named = named.join(labels, F.col("g_id") == F.col("node"), "left").select("g_node", F.coalesce("label", "g_id").alias("component"))
    out = rows.select("id", "raw", "n", "node").join(named, F.col("node") == F.col("g_node"), "left")
    return out.select("id", "raw", F.col("n").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"))


def op9_minhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id",
                      F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component (and those with a null id and no equal
    set with ids), with all columns. Rows that share the kept id
    stay if their texts differ; of rows that agree in both one stays."""
    found = near_duplicates(docs, id_col, text_col).where(F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull()))
    stay = found.select(F.col("id").alias("k_id"), F.col("raw").alias("k_raw")).distinct()
    packed = docs.select(F.struct("*").alias("doc"), F.col(id_col).cast("long").alias("d_id"), F.xxhash64(body(text_col)).alias("d_raw"))
    met = packed.join(stay.hint("shuffle_hash"), F.col("d_id").eqNullSafe(F.col("k_id")) & (F.col("d_raw") == F.col("k_raw")), "left_semi")
    return met.dropDuplicates(["d_id", "d_raw"]).select("doc.*")
