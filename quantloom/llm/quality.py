"""Quality classifier from supervised subword embeddings.

Words, their character n-grams and pairs of neighbouring words are hashed to rows of one
embedding table. A document is the mean of its rows, a softmax layer gives the class, and both
are learned together by stochastic gradient descent. As the model is linear after the
mean, a trained model scores by one number per row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.learning import SparseRows, collect_rows, hashed_sample, sparse_column

_CACHE = 200_000


@dataclass
class Settings:
    """``max_rows`` bounds the labelled training sample (rows, about), and ``max_features`` the
    distinct features of a row in it; a row with more keeps a hashed sample of them."""

    bits: int = 16
    dims: int = 10
    grams: tuple[int, ...] = (3, 4)
    max_rows: int = 5000
    max_features: int = 8192
    epochs: int = 5
    batch: int = 64
    rate: float = 1.0
    seed: int = 5


class Subwords:
    """Hashed features of a text and their counts; equal neighbours all share pair feature 0.

    A pair is the difference of its words' hashes, so its order counts, and a word said
    again and again leaves the same trace whatever the word.
    """

    def __init__(self, bits: int, grams: tuple[int, ...]):
        self.mask, self.grams = (1 << bits) - 1, grams

    def of_word(self, word: bytes) -> list[int]:
        """The word itself, then its character n-grams."""
        shown = b"<" + word + b">"
        parts = [shown, *(shown[i : i + n] for n in self.grams for i in range(len(shown) - n + 1))]
        return [zlib.crc32(p) & self.mask for p in parts]

    def of_pairs(self, heads: np.ndarray) -> np.ndarray:
        return (heads[1:] - heads[:-1]) & self.mask

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.encode().split()
        of = {w: self.of_word(w) for w in set(words)}
        pairs = self.of_pairs(np.array([of[w][0] for w in words], np.int64))
        found, times = np.unique(np.array([f for w in words for f in of[w]] + pairs.tolist(), np.int64), return_counts=True)
        return found.astype(np.int32), times.astype(np.float32)


@dataclass
class Model:
    """Log-odds of class 1 that each feature adds to the mean, and the bias."""

    per_feature: np.ndarray
    bias: float
    bits: int
    grams: tuple[int, ...]


def fit_embeddings(rows: SparseRows, y: np.ndarray, s: Settings) -> Model:
    """Stochastic gradient descent on the cross-entropy of softmax(mean embedding @ out)."""
    rng = np.random.default_rng(s.seed)
    width = 1 << s.bits
    table = rng.uniform(-1 / s.dims, 1 / s.dims, (width, s.dims))
    out, bias = np.zeros((s.dims, 2)), np.zeros(2)
    total = max(1, s.epochs * -(-len(rows) // s.batch))
    share = np.clip(np.bincount(y.astype(int), minlength=2) / max(1, len(y)), 1e-3, None)
    if len(rows):
        bias = np.log(share / share.sum())
    step = 0
    for _ in range(s.epochs if len(rows) else 0):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), s.batch):
            rate = s.rate * (1 - step / total)
            step += 1
            pick = order[i : i + s.batch]
            at, weight, row = rows.pick(pick)
            size = np.bincount(row, weight, len(pick))
            weight = weight / np.maximum(size[row], 1)
            mean = np.zeros((len(pick), s.dims))
            part = table[at]
            for d in range(s.dims):
                mean[:, d] = np.bincount(row, weight * part[:, d], len(pick))
            z = mean @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), y[pick].astype(int)] -= 1  # the gradient, per text
            back = p @ out.T
            out -= rate * mean.T @ p
            bias -= rate * p.mean(0)
            # Rows are hit by many texts; bincount adds them up.
            for d in range(s.dims):
                table[:, d] -= rate * np.bincount(at, weight * back[row, d], width)
    gap = out[:, 1] - out[:, 0]
    return Model((table @ gap).astype(np.float32), float(bias[1] - bias[0]), s.bits, s.grams)


def learn_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    settings: Settings | None = None,
) -> Model:
    """Train from labelled rows only; ``labels`` should hold training rows. No labels: score 0.5.

    An id labelled more than once takes its most frequent label (ties: the lesser); an id of
    several texts is one example, its text of least hash. A text of more than ``max_features``
    distinct features keeps a hashed sample of them, with their weights.
    """
    s = settings or Settings()
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")
    )
    votes = known.groupBy("id", "y").count()
    known = votes.groupBy("id").agg(F.min_by("y", F.struct(-F.col("count"), F.col("y"))).alias("y"))
    # At most twice max_rows ids, so a bounded broadcast.
    chosen = F.broadcast(hashed_sample(known, "id", s.max_rows))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id")
    # Features are made where the texts are read, in parallel; only the chosen ones are grouped.
    found = texts.select("id", "y", F.xxhash64("text").alias("h"), sparse_column(F.col("text"), Subwords(s.bits, s.grams)).alias("f"))
    found = found.groupBy("id", "y").agg(F.min_by("f", "h").alias("f"))
    pairs = F.arrays_zip(F.col("f.at").alias("at"), F.col("f.weight").alias("weight"))
    # The size is of a column: inside the lambda an expression would be made anew for every pair.
    sampled = F.filter(pairs, lambda p: F.pmod(F.xxhash64(p["at"], F.lit("feature")), F.size("f.at")) < s.max_features)
    bounded = F.when(F.size("f.at") > s.max_features, F.struct(sampled["at"].alias("at"), sampled["weight"].alias("weight"))).otherwise(F.col("f"))
    rows, y = collect_rows(found.select("y", bounded.alias("f")), "y")
    return fit_embeddings(rows, y, s)


class _WordTable:
    """Per-word sums of a model's gains, kept by a Python worker across its tasks.

    Rows grow in numpy arrays; at ``size`` words the newer half goes, so frequent words,
    which come early, stay. Memory is bounded by ``size``.
    """

    def __init__(self, model: Model, size: int | None = None):
        self.words = Subwords(model.bits, model.grams)
        self.gain_of = model.per_feature.astype(np.float64)
        self.size, self.index = size or _CACHE, {}
        self.gain, self.count, self.head = np.zeros(1024), np.zeros(1024, np.int64), np.zeros(1024, np.int64)

    def rows(self, texts: list[list[bytes]]) -> np.ndarray:
        """Row of every word of ``texts``, in order, after learning the new ones."""
        new = set().union(*texts).difference(self.index)
        if len(self.index) + len(new) > self.size:
            keep = self.size // 2
            self.index = {w: i for w, i in self.index.items() if i < keep}
            new = set().union(*texts).difference(self.index)
        start = len(self.index)
        if start + len(new) > len(self.gain):
            grown = max(2 * len(self.gain), start + len(new))
            for name in ("gain", "count", "head"):
                old = getattr(self, name)
                made = np.zeros(grown, old.dtype)
                made[:start] = old[:start]
                setattr(self, name, made)
        for k, w in enumerate(new, start):
            found = self.words.of_word(w)
            self.index[w] = k
            self.gain[k], self.count[k], self.head[k] = self.gain_of[found].sum(), len(found), found[0]
        get = self.index.__getitem__
        return np.fromiter((get(w) for t in texts for w in t), np.int64)


_TABLES: dict[tuple, _WordTable] = {}


def _table(model: Model) -> _WordTable:
    key = (model.bits, model.grams, model.bias, zlib.crc32(model.per_feature.tobytes()))
    if key not in _TABLES:
        _TABLES.clear()  # one model a worker at a time
        _TABLES[key] = _WordTable(model)
    return _TABLES[key]


def score_texts(table: _WordTable, bias: float, texts: list[list[bytes]]) -> list[float]:
    """Scores of word lists: mean gain of their words' features and neighbour pairs, softmax."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    rows = table.rows(texts)
    starts = np.cumsum(lengths) - lengths
    # Pairs of neighbours inside each text: every word but a text's first has one.
    pairs = table.words.of_pairs(table.head[rows])
    inside = np.ones(len(pairs), bool)
    inside[starts[(lengths > 0) & (starts > 0)] - 1] = False
    at = np.repeat(np.arange(len(texts)), lengths)
    gains = np.bincount(at, table.gain[rows], len(texts))
    counts = np.bincount(at, table.count[rows].astype(np.float64), len(texts))
    if len(pairs):
        gains += np.bincount(at[1:], np.where(inside, table.gain_of[pairs], 0.0), len(texts))
        counts += np.bincount(at[1:], inside.astype(np.float64), len(texts))
    z = bias + gains / np.maximum(1.0, counts)
    return [round(float(v), 6) for v in 1 / (1 + np.exp(-np.clip(z, -30, 30)))]


def quality(text: Column, model: Model) -> Column:
    """Score from 0 to 1 of class 1; null texts and texts without a word get the bias alone."""

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = _table(model)
        for batch in batches:
            texts = [(t or b"").split() for t in batch.to_pylist()]
            yield pa.array(score_texts(table, model.bias, texts), pa.float64())

    return run(text.cast("binary"))
