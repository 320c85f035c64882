"""BPE encoding by tree concatenation, and decoding.

A text of at most ``leaf`` code points is one leaf. Longer texts are halved until the pieces are leaves;
leaves are dealt over the cluster and encoded in parallel, then joined pairwise, level by level. A join
decodes a window of tokens on both sides of the seam, encodes the window's text again and accepts it
once both sides agree: its first ``AGREE`` tokens are the old ones of the left half and its last ones
those of the right half. Otherwise the window grows to twice its size, in the end over both halves.

Why that is exact: the word pattern keeps no memory beyond a boundary, so a half whose start or end falls
into a word is wrong only in that word; and inside a word, tokens are its encoding if every two
neighbours are the encoding of their own text, which a stretch of equal tokens hands on from one half
to the other. The stretches stay ``MARGIN`` bytes from the seam, more than the look-ahead of the pattern or
the length of the special token, and a window that begins inside a word and splits it otherwise
does not agree.

The vocabulary is a file of a public tokenizer, read by path on every executor. The same ranks are used
through the faster of two libraries; tests hold both against each other.

Defined cases: a null text counts as empty and has no tokens; rows that agree in id and text are encoded
once when they are long; extra columns are ignored by :func:`encoded`.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.llm.common import body, documents, slices, text_buffers
from civicspark.session import settled

SPECIAL = {"<|endoftext|>": 50256}
LEAF = 16_384
CHUNK = 1 << 20
AGREE = 8
MARGIN = 32


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=2)
def codec(path: str):
    """Encoder, the bytes of all tokens in one array, their starts and lengths."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encoder = tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    pieces = dict((rank, token) for token, rank in ranks.items()) | {i: s.encode() for s, i in SPECIAL.items()}
    tokens = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
    lengths = np.array([len(t) for t in tokens], np.int64)
    return encoder, np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lengths) - lengths, lengths


def encode_text(text: str, path: str) -> np.ndarray:
    return np.asarray(codec(path)[0].encode_to_numpy(text, allowed_special="all"), np.uint32)


def decode_bytes(ids: np.ndarray, path: str) -> bytes:
    _, pool, starts, lengths = codec(path)
    n = lengths[ids]
    ends = np.cumsum(n)
    if not len(ids):
        return b""
    return pool[np.arange(ends[-1]) + np.repeat(starts[ids] - (ends - n), n)].tobytes()


def decode_text(ids: np.ndarray, path: str) -> str:
    return decode_bytes(ids, path).decode("utf-8", "replace")


def join_halves(left: np.ndarray, right: np.ndarray, path: str, window: int = 64) -> np.ndarray:
    """The tokens of the joined text from the tokens of its halves."""
    _, pool, starts, lengths = codec(path)
    inside = lambda token: 0x80 <= pool[starts[token]] < 0xC0  # noqa: E731 - the token begins within a code point
    while True:
        a, b = max(0, len(left) - window), min(len(right), window)
        while a > 0 and inside(left[a]):
            a -= 1
        while b < len(right) and inside(right[b]):
            b += 1
        old = np.concatenate([left[a:], right[:b]])
        new = encode_text(decode_text(old, path), path)
        before = a == 0 or (
            lengths[left[a + AGREE:]].sum() >= MARGIN and len(new) > AGREE and np.array_equal(new[:AGREE], left[a:a + AGREE]))
        after = b == len(right) or (
            lengths[right[:b - AGREE]].sum() >= MARGIN and len(new) > AGREE and np.array_equal(new[-AGREE:], right[b - AGREE:b]))
        if before and after:
            return np.concatenate([left[:a], new, right[b:]])
        window *= 2


def parts_of(batch: pa.RecordBatch, column: str):
    """Slices of a batch with a bounded number of bytes in ``column``; a longer value is a slice of its own."""
    _, offsets = text_buffers(batch.column(column))
    for lo, hi in slices(offsets, CHUNK):
        yield batch.slice(lo, hi - lo)


def _encode(path: str):
    def rows(batches):
        for batch in batches:
            for part in parts_of(batch, "t"):
                ids = [encode_text(t, path).astype("<u4").tobytes() for t in part.column("t").to_pylist()]
                yield part.drop_columns(["t"]).append_column("ids", pa.array(ids, pa.binary()))

    return rows


def _halve(leaf: int):
    schema = pa.schema([("id", pa.int64()), ("raw", pa.int64()), ("depth", pa.int32()), ("k", pa.int32()), ("t", pa.string())])

    def rows(batches):
        for batch in batches:
            for part in parts_of(batch, "t"):
                for row in part.to_pylist():
                    text = row["t"]
                    depth = max(0, (len(text) - 1) // leaf).bit_length()
                    cuts = [len(text) * k >> depth for k in range((1 << depth) + 1)]
                    leaves = [{"id": row["id"], "raw": row["raw"], "depth": depth, "k": k, "t": text[cuts[k]:cuts[k + 1]]} for k in range(1 << depth)]
                    yield pa.RecordBatch.from_pylist(leaves, schema)

    return rows


def _join_pairs(path: str):
    def pair(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["k"])
        left, right = (np.frombuffer(r["ids"], "<u4") for r in rows)
        first = rows[0]
        return pa.Table.from_pylist([{
            "id": first["id"], "raw": first["raw"], "depth": first["depth"] - 1, "k": first["k"] // 2, "copies": first["copies"],
            "ids": join_halves(left, right, path).astype("<u4").tobytes()}],
            pa.schema([("id", pa.int64()), ("raw", pa.int64()), ("depth", pa.int32()), ("k", pa.int32()), ("copies", pa.int64()), ("ids", pa.binary())]))

    return pair


_NODE = "id long, raw long, depth int, k int, copies long, ids binary"


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers), one row per row of ``docs``."""
    path = path or vocabulary_path()
    t = body(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), t.alias("t"))
    short = rows.where(F.length("t") <= leaf).mapInArrow(_encode(path), "id long, ids binary")
    cut = rows.where(F.length("t") > leaf).select("id", F.xxhash64("t").alias("raw"), "t").mapInArrow(
        _halve(leaf), "id long, raw long, depth int, k int, t string")
    leaves = cut.groupBy("id", "raw", "depth", "k").agg(F.first("t").alias("t"), F.count(F.lit(1)).alias("copies"))
    level = settled(leaves.select("id", "raw", "depth", "k", "copies", "t").mapInArrow(_encode(path), _NODE), "tokens")
    depth = level.agg(F.max("depth")).first()[0] or 0
    whole = []
    for _ in range(depth):
        whole.append(level.where("depth = 0"))
        pairs = level.where("depth > 0").groupBy("id", "raw", F.shiftright("k", 1).alias("half"))
        level = settled(pairs.applyInArrow(_join_pairs(path), _NODE), "tokens")
    whole.append(level)
    out = short
    for part in whole:
        out = out.unionByName(part.select("id", "ids", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("c")).drop("c"))
    return out.withColumnRenamed("id", "doc_id")


def _decode(path: str):
    def rows(batches):
        for batch in batches:
            for part in parts_of(batch, "ids"):
                texts = [decode_text(np.frombuffer(ids, "<u4"), path) for ids in part.column("ids").to_pylist()]
                yield part.append_column("text", pa.array(texts, pa.string()))

    return rows


def decoded(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """``tokens`` (doc_id, ids) with their text."""
    return tokens.mapInArrow(_decode(path or vocabulary_path()), "doc_id long, ids binary, text string")


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and text of decoded rows."""
    return tokens.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(decoded(encoded(documents(spark, sf_dir))))
