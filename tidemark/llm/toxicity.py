"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives P; a draw from all documents, labels unseen, is U. A linear
classifier over words and word beginnings is trained in numpy on

    prior * E_P[loss(g)] + max(0, E_U[loss(-g)] - prior * E_P[loss(-g)])

whose second term is the class-prior-corrected risk of the negatives; where it would fall below zero the
step goes the other way, so the model cannot overfit by pretending that U has fewer negatives than none.
The prior is the share of positives among the labelled rows of the learning folds.

Features: that a word, or a beginning of one of SHORTEST to LONGEST bytes, comes at least once, twice, four
times. All of them take part, hashed to DIMENSIONS places, so the model has one size at every size of the
corpus. A feature's value is larger the more significant its excess in P over U is (a likelihood ratio), and
next to nothing where it could be chance; so few positives do not drown in words that tell nothing.

Bounds, which are parameters: the classifier is fitted on at most ``max_positive`` positives and
``max_unlabelled`` unlabelled documents, picked by a hash of the id over all rows. Whole texts are read, and
every document is scored, where it lies.

Defined cases: null and empty texts have no features, so they get the intercept's score; very long texts have
the features of all their words; without any positive in the learning folds every score is next to 0; rows
of equal text have equal scores; labels for unknown ids, null labels and null ids are ignored; a label repeated
for an id counts once (toxic if any is). Empty tables give empty results; other columns pass through, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_words, discard, written

SHORTEST, LONGEST = 4, 8
#: A feature says that a word or beginning comes at least so many times.
TIMES = (1, 2, 4)
DIMENSIONS = 1 << 18


class Parts:
    """Hashes of words and their beginnings, remembered up to a bound."""

    def __init__(self, most: int = 400_000):
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.first, self.count, self.hashes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def learn(self, words: set[bytes]) -> None:
        known = list(words)
        parts = [[w, *(w[:k] + b"-" for k in range(SHORTEST, min(LONGEST, len(w) - 1) + 1))] for w in known]
        self.number.update(zip(known, range(len(self.number), len(self.number) + len(known)), strict=True))
        count = np.array([len(x) for x in parts], np.int64)
        self.first = np.concatenate([self.first, len(self.hashes) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.hashes = np.concatenate([self.hashes, np.array([xxhash.xxh3_64_intdigest(x) for own in parts for x in own], np.uint64)])

    def features(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Text and place of every feature, in order."""
        if len(self.number) > self.most:
            self.forget()
        words = [ascii_words(x.lower()) if x else [] for x in texts]
        flat = [w for own in words for w in own]
        if new := set(flat).difference(self.number):
            self.learn(new)
        number = np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat))
        count = self.count[number]
        at = np.repeat(self.first[number] - np.cumsum(count) + count, count) + np.arange(count.sum())
        text = np.repeat(np.repeat(np.arange(len(texts)), [len(w) for w in words]), count)
        # one sort: the text, then the hash's place; what shares both is one part
        key, n = np.unique(text.astype(np.uint64) << np.uint64(40) | self.hashes[at] >> np.uint64(24), return_counts=True)
        rows, places = [], []
        for t in TIMES:
            own = key[n >= t]
            mixed = (own & np.uint64((1 << 40) - 1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(t * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
            mixed ^= mixed >> np.uint64(32)
            rows.append((own >> np.uint64(40)).astype(np.int64))
            places.append((mixed & np.uint64(DIMENSIONS - 1)).astype(np.int32))
        row, place = np.concatenate(rows), np.concatenate(places)
        order = np.argsort(row, kind="stable")
        return row[order], place[order]


_parts = Parts()


@dataclass(frozen=True, eq=False)
class Model:
    bias: float
    weights: np.ndarray

    def logits(self, texts: list[str | None]) -> np.ndarray:
        row, place = _parts.features(texts)
        return self.bias + np.bincount(row, self.weights[place], len(texts)) if len(row) else np.full(len(texts), self.bias)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass(frozen=True)
class Sparse:
    """Rows of features: from ``starts[k]`` to ``starts[k + 1]`` the places and values of row k."""

    starts: np.ndarray
    places: np.ndarray
    values: np.ndarray

    def __len__(self) -> int:
        return len(self.starts) - 1

    def pieces(self, most: int = 1_000_000) -> Iterator[tuple[int, int, slice]]:
        """Ranges of rows with some ``most`` features, so that no step needs more memory than a range does."""
        a = 0
        while a < len(self):
            b = max(a + 1, int(np.searchsorted(self.starts, self.starts[a] + most, side="right")) - 1)
            yield a, b, slice(int(self.starts[a]), int(self.starts[b]))
            a = b

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.empty(len(self))
        for a, b, own in self.pieces():
            sums = np.concatenate([[0.0], np.cumsum(self.values[own] * w[self.places[own]], dtype=np.float64)])
            at = self.starts[a : b + 1] - own.start
            out[a:b] = sums[at[1:]] - sums[at[:-1]]
        return out

    def back(self, r: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(size)
        for a, b, own in self.pieces():
            out += np.bincount(self.places[own], self.values[own] * np.repeat(r[a:b], np.diff(self.starts[a : b + 1])), size)
        return out


def risk_and_gradient(positive: Sparse, unlabelled: Sparse, prior: float, w: np.ndarray) -> tuple[float, float, np.ndarray]:
    """Of weights (the first: the intercept): the risk of positives, the corrected risk of negatives, and the
    gradient of the non-negative risk's step, all for the logistic loss."""

    def gradient(x: Sparse, g: np.ndarray, s: float) -> np.ndarray:
        """Of the mean of log(1 + exp(-s g)); s: the sign."""
        r = -s * sigmoid(-s * g) / max(len(x), 1)
        return np.concatenate([[r.sum()], x.back(r, len(w) - 1)])

    g_p, g_u = (w[0] + x.dot(w[1:]) for x in (positive, unlabelled))
    mean = [float(np.logaddexp(0, -s * g).mean()) if len(g) else 0.0 for g, s in ((g_p, 1.0), (g_u, -1.0), (g_p, -1.0))]
    negative = mean[1] - prior * mean[2]
    corrected = gradient(unlabelled, g_u, -1.0) - prior * gradient(positive, g_p, -1.0)
    return prior * mean[0], negative, prior * gradient(positive, g_p, 1.0) + corrected if negative >= 0 else -corrected


def train(positive: Sparse, unlabelled: Sparse, prior: float, size: int, steps: int = 200, rate: float = 0.1, decay: float = 1e-4) -> tuple[float, np.ndarray]:
    """Full batches, Adam."""
    w = np.zeros(size + 1)
    w[0] = np.log(prior / (1 - prior))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        g = risk_and_gradient(positive, unlabelled, prior, w)[2]
        g[1:] += decay * w[1:]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return float(w[0]), w[1:]


def significance(p: np.ndarray, u: np.ndarray, n_p: int, n_u: int) -> np.ndarray:
    """Log likelihood ratio of a Poisson count in P against what U leads to expect; 0 without an excess."""
    expected = (u + 1) * (n_p / (n_u + 1))
    return np.where(p > expected, p * np.log(np.maximum(p, 1) / expected) - p + expected, 0.0)


def fold(identity: Column, folds: int = 5) -> Column:
    return F.crc32(identity.cast("string").cast("binary")) % folds


def learn(docs: DataFrame, labels: DataFrame, learning: Column | None = None, max_positive: int = 8_000, max_unlabelled: int = 12_000, half: float = 14.0, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """``learning``: a condition on the id that rows used for learning must meet. ``half``: the significance at
    which a feature has half of its full value. ``labels``: the id, toxic."""
    learning = F.lit(True) if learning is None else learning
    identity = F.col(f"`{id_col}`")
    known = labels.where(identity.isNotNull() & F.col("toxic").isNotNull() & learning).groupBy(identity.alias("i")).agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not toxic:
        return Model(-20.0, np.zeros(DIMENSIONS))
    prior = min(max(toxic / n, 1e-4), 0.9)
    positives = known.where("toxic = 1").select("i").orderBy(F.xxhash64("i"), "i").limit(max_positive)
    anyone = docs.where(identity.isNotNull() & learning).select(identity.alias("i")).distinct().orderBy(F.xxhash64(F.lit(1), "i"), "i").limit(max_unlabelled)
    picked = (
        positives.select("i", F.lit(1).alias("p"), F.lit(0).alias("u"))
        .unionByName(anyone.select("i", F.lit(0).alias("p"), F.lit(1).alias("u")))
        .groupBy("i").agg(F.max("p").alias("p"), F.max("u").alias("u"))
    )
    # at most max_positive + max_unlabelled ids
    sample = written(docs.select(identity.alias("i"), F.col(f"`{text_col}`").alias("t")).join(F.broadcast(picked), "i").select("p", "u", "t"), "toxicity-sample")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                rows = b.slice(at, 200)
                row, place = _parts.features(rows.column("t").to_pylist())
                ends = np.searchsorted(row, np.arange(rows.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([rows.column("p"), rows.column("u"), pa.ListArray.from_arrays(pa.array(ends), pa.array(place))], ["p", "u", "x"])

    # the features of a sample of bounded size
    rows = sample.mapInArrow(found, "p int, u int, x array<int>").toArrow().combine_chunks()
    discard(sample)
    lists = rows.column("x").combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.int32()))
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0)
    ends, places = lists.offsets.to_numpy(), lists.values.to_numpy()
    sides = [rows.column(x).to_numpy() == 1 for x in ("p", "u")]
    if not all(s.any() for s in sides):
        return Model(float(np.log(prior / (1 - prior))), np.zeros(DIMENSIONS))
    # in an order of their own, so that sums do not depend on how rows were dealt
    order = sorted(range(len(ends) - 1), key=lambda k: xxhash.xxh3_128_digest(places[ends[k] : ends[k + 1]].tobytes()))

    def of(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = [places[ends[k] : ends[k + 1]] for k in order if side[k]]
        return np.cumsum([0, *map(len, own)]), np.concatenate(own)

    (start_p, place_p), (start_u, place_u) = map(of, sides)
    z = significance(np.bincount(place_p, minlength=DIMENSIONS), np.bincount(place_u, minlength=DIMENSIONS), len(start_p) - 1, len(start_u) - 1)
    value = ((z / half) ** 2 / (1 + (z / half) ** 2)).astype(np.float32)

    def sparse(starts: np.ndarray, at: np.ndarray) -> Sparse:
        """Without zeros, which no step would move."""
        some = value[at] > 0
        return Sparse(np.concatenate([[0], np.cumsum(some)])[starts], at[some], value[at[some]])

    of_p, of_u = sparse(start_p, place_p), sparse(start_u, place_u)
    del rows, lists, places, place_p, place_u
    bias, weights = train(of_p, of_u, prior, DIMENSIONS)
    return Model(bias, weights * value)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """Adds ``out``: the probability that a document is toxic."""
    # one array of DIMENSIONS numbers
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))

    def run(text: pa.Array) -> pa.Array:
        m = Model(*shared.value)
        parts = [m.logits(text.slice(at, 200).to_pylist()) for at in range(0, len(text), 200)]
        return pa.array(sigmoid(np.concatenate([np.zeros(0), *parts])), pa.float64())

    return docs.withColumn(out, F.arrow_udf(run, "double")(F.col(f"`{text_col}`")))
