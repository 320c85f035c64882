"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds turn the score
into P(grade >= k) = sigmoid(score - threshold_k), hence an expected grade and tail probabilities.
Features are byte trigrams and word shapes (letter case, edges, symbols, length, repeat of the word
before), hashed into ``DIMS`` places, as square roots of their shares, so length does not matter.

The model is fitted on the driver from at most ``sample`` rated documents (those with the smallest hash
of their id; their features are made on the executors). Scoring reads every text whole.

Grades here: 0 rated poor, 1 good but marked toxic, 2 good. Documents are selected by the tail
P(grade >= 1).

Defined cases: a null text counts as empty and scores 0 plus the intercept held by the thresholds;
ratings repeated for an id count once, the lowest of them; ratings without a document, or with a null
grade, are ignored; without any ratings the thresholds are even and everything is kept; extra columns
are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspark.llm.common import U64, _IS_SPACE, body, documents, hashed_words, labels, mixed, slices, text_buffers

TRIGRAMS, SHAPES = 4096, 512
DIMS = TRIGRAMS + SHAPES
SAMPLE = 4000
CHUNK = 1 << 20
ROWS = 64  # rows times DIMS in a dense block, which a worker holds several times
_CLASS = np.full(256, 3, np.uint8)  # punctuation and other ASCII
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[128:] = 0
_CLASS[[ord(c) for c in ".,;:'\"-()"]] = 4


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of DIMS values per text, of length sqrt(2) at most."""
    rows = len(offsets) - 1
    out = np.zeros((rows, DIMS), np.float32)
    if len(data) >= 3:
        row = np.repeat(np.arange(rows), np.diff(offsets))
        x = data.astype(U64)
        grams = mixed(x[:-2] | (x[1:-1] << U64(8)) | (x[2:] << U64(16))) & U64(TRIGRAMS - 1)
        same = row[:-2] == row[2:]
        place = row[:-2][same] * TRIGRAMS + grams[same].astype(np.int64)
        out[:, :TRIGRAMS] = _shares(np.bincount(place, minlength=rows * TRIGRAMS).reshape(rows, TRIGRAMS))
    words, of = hashed_words(data, offsets)
    if len(words):
        member = ~_IS_SPACE[data]
        first = member.copy()
        first[1:] &= ~member[:-1]
        cuts = offsets[:-1][offsets[:-1] < len(data)]
        first[cuts] = member[cuts]
        starts = np.flatnonzero(first)
        after = np.append(np.flatnonzero(member & ~np.append(member[1:] & ~first[1:], False)), [])[:len(starts)].astype(np.int64)
        length = after - starts + 1
        second = np.minimum(starts + 1, after)
        repeat = np.concatenate([[False], (words[1:] == words[:-1]) & (of[1:] == of[:-1])])
        shape = _CLASS[data[starts]].astype(U64)
        for part in (_CLASS[data[second]], _CLASS[data[after]], _CLASS[data[np.maximum(after - 1, starts)]],
                     np.minimum(length, 12) // 4, repeat):
            shape = shape * U64(8) + part.astype(U64)
        place = of * SHAPES + (mixed(shape) & U64(SHAPES - 1)).astype(np.int64)
        out[:, TRIGRAMS:] = _shares(np.bincount(place, minlength=rows * SHAPES).reshape(rows, SHAPES))
    return out


def _shares(counts: np.ndarray) -> np.ndarray:
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).astype(np.float32)


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one per grade above the lowest

    def tail(self, score: Column, grade: int) -> Column:
        """P(grade or better)."""
        return 1 / (1 + F.exp(F.lit(float(self.thresholds[grade - 1])) - score))

    def expected(self, score: Column) -> Column:
        total = F.lit(0.0)
        for grade in range(1, len(self.thresholds) + 1):
            total = total + self.tail(score, grade)
        return total


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(features: np.ndarray, grades: np.ndarray, levels: int, rounds: int = 300, rate: float = 0.2, ridge: float = 1e-4) -> OrdinalModel:
    """Maximum likelihood by Adam over all rows; thresholds stay ordered as a first one plus positive steps."""
    counts = np.bincount(grades, minlength=levels) + 1.0
    tails = np.cumsum(counts[::-1])[::-1][1:] / counts.sum()
    theta = -np.log(tails / (1 - tails))  # without features: the smoothed shares
    if not len(grades) or len(np.unique(grades)) < 2:
        return OrdinalModel(np.zeros(DIMS, np.float32), theta)
    x = features.astype(np.float32)
    w, first, steps = np.zeros(x.shape[1]), theta[0], np.log(np.maximum(np.diff(theta), 1e-3))
    params = np.concatenate([w, [first], steps])
    m, v = np.zeros_like(params), np.zeros_like(params)
    rows = np.arange(len(grades))
    for t in range(1, rounds + 1):
        w, first, steps = params[:x.shape[1]], params[x.shape[1]], params[x.shape[1] + 1:]
        theta = first + np.concatenate([[0.0], np.cumsum(np.exp(steps))])
        eta = x @ w.astype(np.float32)
        above = np.concatenate([np.ones((len(rows), 1)), _sigmoid(eta[:, None] - theta), np.zeros((len(rows), 1))], axis=1)
        p = np.maximum(above[rows, grades] - above[rows, grades + 1], 1e-9)
        slope = above * (1 - above)
        g_eta = (slope[rows, grades] - slope[rows, grades + 1]) / p
        g_theta = np.zeros((len(rows), levels + 1))
        g_theta[rows, grades] -= slope[rows, grades] / p
        g_theta[rows, grades + 1] += slope[rows, grades + 1] / p
        g_theta = g_theta.mean(axis=0)[1:levels]
        from_here = np.cumsum(g_theta[::-1])[::-1]
        grad = np.concatenate([x.T @ (g_eta / len(rows)).astype(np.float32) - ridge * w, [from_here[0]], from_here[1:] * np.exp(steps)])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    steps = params[x.shape[1] + 1:]
    return OrdinalModel(params[:x.shape[1]].astype(np.float32), params[x.shape[1]] + np.concatenate([[0.0], np.cumsum(np.exp(steps))]))


def _sparse(batches):
    for batch in batches:
        data, offsets = text_buffers(batch.column("t"))
        for lo, hi in slices(offsets, CHUNK, ROWS):
            x = text_features(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
            places = [np.flatnonzero(r) for r in x]
            own = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays(
                [own.column("id"), own.column("grade"), pa.array([p.astype("<u2").tobytes() for p in places], pa.binary()),
                 pa.array([r[p].astype("<f4").tobytes() for r, p in zip(x, places, strict=True)], pa.binary())],
                names=["id", "grade", "places", "amounts"])


def train(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", levels: int = 3, sample: int = SAMPLE) -> OrdinalModel:
    """``ratings``: id and grade (0 to levels - 1). The sample is a documented bound, not a share."""
    rated = ratings.where("grade is not null").groupBy("r_id").agg(F.min("grade").cast("int").alias("grade"))
    rated = rated.orderBy(F.xxhash64("r_id"), "r_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), body(text_col).alias("t")).join(F.broadcast(rated), F.col("id") == F.col("r_id"))
    table = rows.select(F.col("id").cast("string").alias("id"), "grade", "t").mapInArrow(
        _sparse, "id string, grade int, places binary, amounts binary").toArrow().to_pylist()
    table.sort(key=lambda r: (r["id"], r["grade"], r["places"], r["amounts"]))
    x = np.zeros((len(table), DIMS), np.float32)
    for i, row in enumerate(table):
        x[i, np.frombuffer(row["places"], "<u2")] = np.frombuffer(row["amounts"], "<f4")
    return fit(x, np.array([r["grade"] for r in table], np.int64), levels)


def score_texts(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Scores of a batch; its dense blocks are bounded by bytes and by rows."""
    data, offsets = text_buffers(texts)
    out = [text_features(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]) @ weights for lo, hi in slices(offsets, CHUNK, ROWS)]
    return np.concatenate(out).astype(np.float64) if out else np.zeros(0)


def scored(text: Column, model: OrdinalModel) -> Column:
    """The score of a text; ``model`` turns it into tail probabilities and an expected grade."""
    weights = model.weights

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(score_texts(texts, weights))

    return score(text)


def ratings_of(marks: DataFrame) -> DataFrame:
    """Grades from the two marks of the table of labels; a missing toxicity mark counts as none."""
    grade = F.when(F.col("quality") == 1, F.when(F.coalesce("toxic", F.lit(0)) == 1, 1).otherwise(2)).when(F.col("quality") == 0, 0)
    return marks.select(F.col("doc_id").alias("r_id"), grade.alias("grade"))


def graded(docs: DataFrame, ratings: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc (all columns), score, expected grade, tail and kept: whether P(grade >= 1) is at least ``least``."""
    model = train(docs, ratings, id_col, text_col)
    out = docs.select(F.struct("*").alias("doc"), scored(F.col(text_col), model).alias("score"))
    out = out.withColumn("tail", model.tail(F.col("score"), 1)).withColumn("expected_grade", model.expected(F.col("score")))
    return out.withColumn("kept", F.col("tail") >= least)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    out = graded(documents(spark, sf_dir).select("doc_id", "text"), ratings_of(labels(spark, sf_dir)))
    return out.select("doc.doc_id", "expected_grade", F.col("tail").alias("p_good"), "kept")
