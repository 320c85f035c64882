"""Toxicity by weak supervision.

Voters: every word of a small lexicon, every word that the label of the training rows marks beyond chance
(mined as hashes; a limit on its statistic, none on their number), patterns of spelling, and one that fires
if no word voter does. A voter
that does not fire abstains. A generative model of the votes then
estimates, without labels, how often each voter fires in either class (its accuracy) by expectation
maximisation, and the correlations of voters that remain within the classes; a voter's say is divided by
one plus its correlations, so that echoes count once. A linear classifier over all hashed words that at least
three training rows hold, and over the patterns, is trained on the posterior labels as sparse rows: one penalty
chooses the words, a weaker one sets their weights. It scores every text.

Labels, mined words and votes come from at most ``sample`` labelled rows outside the held-out third; the
bound is a parameter. Scoring reads every text whole: the presence of words counts, not their share.

Defined cases: a null text counts as empty and gets the score of the intercept; labels repeated for an
id count once, the highest; rows with a null id are scored and never learned from; a null label is no
label; without labels the lexicon and the patterns vote alone; without any rows the score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspark.llm.common import U64, _IS_ALNUM, body, documents, hashed_words, labels, slices, text_buffers

DIMS = 1 << 40
SAMPLE = 16000
BEYOND_CHANCE = 2.0  # standard errors of the log odds of a mined voter
CHUNK = 1 << 20
CHUNK_ROWS = 2048
ECHO = 0.6  # from this correlation within the classes on, voters are echoes of each other
# Common insults, as a start; what they are worth is estimated.
LEXICON = (
    "idiot idiots moron morons stupid dumb fool trash garbage scum loser losers pathetic worthless disgusting clown filth "
    "vermin ugly liar coward jerk creep freak hate kill dumm trottel abschaum idiota basura imbecile ordure crétin").split()
PATTERNS = ("marks", "masked", "shout", "short", "quiet")


def buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes & U64(DIMS - 1)).astype(np.int64)


def word_buckets(words: list[str]) -> np.ndarray:
    data = [w.encode() for w in words]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    return buckets(hashed_words(np.frombuffer(b"".join(data), np.uint8), offsets, _IS_ALNUM)[0])


def present(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, word) as rows and buckets, in order."""
    words, rows = hashed_words(data, offsets, _IS_ALNUM)
    both = np.unique(rows * DIMS + buckets(words))
    return both // DIMS, both % DIMS


def patterns(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """rows x patterns of spelling: exclamation runs, masked letters, mostly capitals, hardly any text."""
    rows = len(offsets) - 1
    sizes = np.diff(offsets)
    out = np.zeros((rows, 4), bool)
    out[:, 3] = sizes < 20
    if len(data):
        row = np.repeat(np.arange(rows), sizes)
        bang = data == 33
        out[row[1:][bang[1:] & bang[:-1] & (row[1:] == row[:-1])], 0] = True
        star = (data[1:] == 42) & _IS_ALNUM[data[:-1]] & (row[1:] == row[:-1])
        out[row[1:][star], 1] = True
        upper = np.bincount(row[(data > 64) & (data < 91)], minlength=rows)
        lower = np.bincount(row[(data > 96) & (data < 123)], minlength=rows)
        out[:, 2] = upper > lower
    return out


def label_model(votes: np.ndarray, start: np.ndarray, prior: float, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of class 1 for every row of ``votes`` (0/1), the log odds of every voter and the matrix of
    correlations within classes. ``start``: a first guess of the posterior; ``prior``: the share of class 1."""
    q = np.clip(start.astype(np.float64), 0.01, 0.99)
    n, k = votes.shape
    row, col = (x.astype(np.int32) for x in np.nonzero(votes))
    forth = lambda w: np.bincount(row, weights=w[col], minlength=n)
    back = lambda w: np.bincount(col, weights=w[row], minlength=k)
    both = np.zeros((k, k))
    for lo in range(0, n, CHUNK_ROWS):
        part = votes[lo:lo + CHUNK_ROWS].astype(np.float32)
        both += part.T @ part
    for _ in range(rounds):
        hot, cold = back(q), back(1 - q)
        hit = np.clip((hot + 0.1) / (q.sum() + 1), 1e-6, 1 - 1e-6)
        miss = np.clip((cold + 0.1) / ((1 - q).sum() + 20), 1e-6, 1 - 1e-6)
        fired = np.log(hit / miss)  # a voter that does not fire abstains and says nothing
        # products of what the classes leave unexplained, v - (q hit + (1 - q) miss), from sums alone
        half = np.outer(hot, hit) + np.outer(cold, miss)
        cross = np.outer(hit, miss)
        mean = (q @ q) * np.outer(hit, hit) + (q @ (1 - q)) * (cross + cross.T) + ((1 - q) @ (1 - q)) * np.outer(miss, miss)
        ties = (both - half - half.T + mean) / n
        spread = np.sqrt(np.maximum(np.diag(ties), 0)) + 1e-6
        ties = ties / spread / spread[:, None]
        np.fill_diagonal(ties, 0)
        say = 1 / (1 + np.where(ties > ECHO, ties, 0).sum(axis=0))
        odds = np.log(prior / (1 - prior)) + forth(fired * say)
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - q).max() < 1e-4:
            q = new
            break
        q = new
    return q, fired * say, ties


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[int, float]
    intercept: float
    spelling: tuple[float, ...] = (0.0,) * 4

    def lookup(self) -> tuple[np.ndarray, np.ndarray]:
        places = np.array(sorted(self.weights), np.int64)
        return places, np.array([self.weights[int(p)] for p in places], np.float64)


def classifier(rows: np.ndarray, words: np.ndarray, spelling: np.ndarray, q: np.ndarray, select: float = 0.04, settle: float = 0.0025) -> ToxicityModel:
    """Two fits: a strong penalty chooses among all words, a weak one then sets the weights of the chosen, which
    the first has shrunk. Both strengths, and ``BEYOND_CHANCE``, were chosen by folds within training rows."""
    chosen, _ = linear(rows, words, spelling, q, select).lookup()
    kept = np.isin(words, chosen)
    return linear(rows[kept], words[kept], spelling, q, settle)


def linear(rows: np.ndarray, words: np.ndarray, spelling: np.ndarray, q: np.ndarray, strength: float, rounds: int = 400, most: float = 2.0) -> ToxicityModel:
    """Logistic regression on the presence of words and patterns with soft labels; the rarer class weighs more,
    up to ``most`` times. Words of fewer than three rows take no part; an L1 penalty (accelerated proximal steps)
    leaves those that carry the decision. Rows stay lists of their columns, so work grows with the words."""
    n, total = len(q), q.sum()
    seen, code = np.unique(words, return_inverse=True)
    used = np.flatnonzero(np.bincount(code, minlength=len(seen)) >= 3)
    column = np.full(len(seen), -1)
    column[used] = np.arange(len(used))
    hit = column[code] >= 0
    marked, kind = np.nonzero(spelling)
    row = np.concatenate([rows[hit], marked, np.arange(n)]).astype(np.int32)
    col = np.concatenate([column[code[hit]], len(used) + kind, np.full(n, len(used) + spelling.shape[1])]).astype(np.int32)
    del code, hit
    size = len(used) + spelling.shape[1] + 1
    forth = lambda w: np.bincount(row, weights=w[col], minlength=n)
    back = lambda g: np.bincount(col, weights=g[row], minlength=size)
    weight = np.where(q > 0.5, min(most, max(1.0, (n - total) / max(total, 1.0))), 1.0)
    weight /= weight.sum()
    penalty = np.full(size, strength / np.sqrt(total + 1))
    penalty[-1] = 0.0
    probe = np.ones(size)
    for _ in range(20):  # the largest curvature
        probe = back(weight * forth(probe / np.linalg.norm(probe)))
    step = 4 / max(np.linalg.norm(probe), 1e-6)
    now, last, t = np.zeros(size), np.zeros(size), 1.0
    for _ in range(rounds):
        g = weight * (1 / (1 + np.exp(-np.clip(forth(now), -30, 30))) - q)
        new = now - step * back(g)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        nxt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        now, last, t = new + (t - 1) / nxt * (new - last), new, nxt
    keep = np.flatnonzero(last[:len(used)])
    return ToxicityModel({int(seen[used[i]]): float(last[i]) for i in keep}, float(last[-1]), tuple(map(float, last[len(used):-1])))


def _words(batches):
    for batch in batches:
        data, offsets = text_buffers(batch.column("t"))
        for lo, hi in slices(offsets, CHUNK):
            part, cuts = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
            rows, words = present(part, cuts)
            bounds = np.searchsorted(rows, np.arange(hi - lo + 1))
            seen = patterns(part, cuts)
            own = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays(
                [own.column("id"), own.column("mark"),
                 pa.array([words[a:b].astype("<i8").tobytes() for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary()),
                 pa.array([np.packbits(s).tobytes() for s in seen], pa.binary())], names=["id", "mark", "words", "seen"])


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, marks: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark_col: str = "toxic", sample: int = SAMPLE) -> ToxicityModel:
    known = marks.where(F.col(mark_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("m_id")).agg(F.max(mark_col).cast("int").alias("mark"))
    known = known.where("m_id is not null").orderBy(F.xxhash64("m_id"), "m_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), body(text_col).alias("t")).join(F.broadcast(known), F.col("id") == F.col("m_id"))
    table = rows.select(F.col("id").cast("string").alias("id"), "mark", "t").mapInArrow(
        _words, "id string, mark int, words binary, seen binary").toArrow().to_pylist()
    table.sort(key=lambda r: (r["id"], r["mark"], r["words"]))
    if not table:
        return ToxicityModel({}, 0.0)
    words = [np.frombuffer(r["words"], "<i8") for r in table]
    at = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) for w in words])
    flat = np.concatenate(words)
    mark = np.array([r["mark"] for r in table], bool)
    spelling = np.stack([np.unpackbits(np.frombuffer(r["seen"], np.uint8))[:4] for r in table])
    del words, table
    voters = _voters(at, flat, mark)
    votes = np.zeros((len(mark), len(voters) + len(PATTERNS)), np.int8)
    order = np.searchsorted(voters, flat)
    hits = (order < len(voters)) & (voters[np.minimum(order, len(voters) - 1)] == flat)
    votes[at[hits], order[hits]] = 1
    votes[:, len(voters):-1] = spelling
    votes[:, -1] = votes[:, :len(voters)].max(axis=1) == 0  # quiet: no word voter fires
    guess = 0.02 + 0.96 * (votes[:, -1] == 0)
    q, _, _ = label_model(votes, guess, (mark.sum() + 1) / (len(mark) + 10))
    del votes
    return classifier(at, flat, spelling, q)


def _voters(rows: np.ndarray, words: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """The lexicon and every word whose log odds lie beyond chance and beyond e to the 2.5th, in at least 3 marked rows."""
    seen, code = np.unique(words, return_inverse=True)
    hot = np.bincount(code[mark[rows]], minlength=len(seen))
    cold = np.bincount(code[~mark[rows]], minlength=len(seen))
    odds = np.log((hot + 0.5) / (mark.sum() + 1)) - np.log((cold + 0.5) / ((~mark).sum() + 1))
    error = np.sqrt(1 / (hot + 0.5) + 1 / (cold + 0.5))
    mined = seen[(hot >= 3) & (odds > 2.5) & (odds > BEYOND_CHANCE * error)]
    return np.unique(np.concatenate([word_buckets(LEXICON), mined]))


def scored(text: Column, model: ToxicityModel) -> Column:
    places, values = model.lookup()
    intercept, spelling = model.intercept, np.array(model.spelling)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        data, offsets = text_buffers(texts)
        out = np.full(len(texts), intercept)
        for lo, hi in slices(offsets, CHUNK):
            part, cuts = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
            out[lo:hi] += patterns(part, cuts) @ spelling
            words, rows = hashed_words(part, cuts, _IS_ALNUM)
            own = buckets(words)
            at = np.searchsorted(places, own)
            hit = np.flatnonzero((at < len(places)) & (places[np.minimum(at, len(places) - 1)] == own)) if len(places) else at[:0]
            if len(hit):
                both = np.unique(rows[hit] * len(places) + at[hit])
                out[lo:hi] += np.bincount(both // len(places), weights=values[both % len(places)], minlength=hi - lo)
        return pa.array(1 / (1 + np.exp(-np.clip(out, -30, 30))))

    return score(text)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs, labels(spark, sf_dir))
    out = docs.select("doc_id", held_out().alias("held_out"), scored(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
