"""Toxicity by non-negative positive-unlabelled learning.

The model is logistic over hashed words. It sees confirmed toxic examples and unlabelled text
only. With the toxic share ``prior``, the risk of calling unlabelled text clean, less the part
its hidden toxic texts have in it, stands for the risk on clean text; where that estimate
turns negative, which only overfitting does, its gradient is reversed.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.learning import SparseRows, collect_rows, hashed_sample, sparse_column
from quantloom.session import materialise

_WORD = re.compile(r"[^\W\d_]+").findall
_CACHE = 200_000


@dataclass
class Settings:
    """``max_positive`` bounds the confirmed toxic rows trained on (labelled rows, about twice
    at most); a row of more than ``max_features`` distinct words keeps a hashed sample of them.
    The unlabelled side is the whole corpus, read once per step: ``steps`` full-batch steps,
    each shuffling at most ``2^bits`` sums per task."""

    bits: int = 16
    max_positive: int = 6000
    max_features: int = 8192
    min_rows: int = 3  # of the whole corpus that a word must be in
    steps: int = 30
    rate: float = 0.5
    sparsity: float = 1e-4
    beta: float = 0.0
    gamma: float = 1.0
    seed: int = 11


class WordBuckets:
    """Distinct hashed words of a text, each with weight 1."""

    def __init__(self, bits: int):
        self.bits, self.known = bits, {}

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words, known = set(_WORD(text.lower())), self.known
        if len(known) > _CACHE:
            known.clear()
        for w in words.difference(known):
            known[w] = zlib.crc32(w.encode()) & ((1 << self.bits) - 1)
        at = np.unique(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
        return at, np.ones(len(at), np.float32)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, at: np.ndarray) -> float:
        return float(_sigmoid(self.weights[at].sum() + self.bias))


class Unlabelled:
    """Unlabelled rows held in memory: their loss of being called clean and its gradient."""

    def __init__(self, rows: SparseRows):
        self.rows, self.entries = rows, np.repeat(np.arange(len(rows)), rows.size)

    def __len__(self) -> int:
        return len(self.rows)

    def counts(self, width: int) -> np.ndarray:
        return np.bincount(self.rows.at, minlength=width)

    def clean_loss(self, w: np.ndarray, bias: float) -> tuple[float, np.ndarray, float]:
        """Mean of log(1 + e^z) over the rows, its gradient in the weights and in the bias."""
        return _clean_loss(self.rows.at, self.rows.weight, self.entries, len(self.rows), w, bias)


def _clean_loss(at, weight, entries, n, w, bias) -> tuple[float, np.ndarray, float]:
    z = np.bincount(entries, w[at] * weight, n) + bias
    p = _sigmoid(z)
    grad = np.bincount(at, p[entries] * weight, len(w))
    return float(np.logaddexp(0, z).sum()), grad, float(p.sum())


def fit_nnpu(positive: SparseRows, unlabelled, prior: float, s: Settings) -> Model:
    """Minimise prior * E_p[l(f)] + max(-beta, E_u[l(-f)] - prior * E_p[l(-f)]) with l(z) = log(1 + exp(-z)).

    Full-batch steps (AdaGrad, L1 by soft thresholding): every step sees all positive rows and
    all unlabelled rows, so the estimate of the clean risk is the corpus's, not a sample's.
    ``unlabelled`` is a ``SparseRows`` or anything with ``__len__``, ``counts`` and
    ``clean_loss`` (``CorpusRows`` reads a stored table in Spark). A word must be in
    ``min_rows`` unlabelled rows, counted over all of them, to get a weight.
    """
    if isinstance(unlabelled, SparseRows):
        unlabelled = Unlabelled(unlabelled)
    width = 1 << s.bits
    w, bias = np.zeros(width), float(np.log(max(prior, 1e-3) / max(1 - prior, 1e-3)))
    total = len(unlabelled)
    if not len(positive) or not total:
        return Model(w.astype(np.float32), -3.0 if not len(positive) else bias, prior)
    usable = unlabelled.counts(width) >= s.min_rows  # a word of one or two texts tells those texts, not their kind
    entries_p = np.repeat(np.arange(len(positive)), positive.size)
    at_p, weight_p = positive.at.astype(np.int64), positive.weight.astype(np.float64)
    seen, seen_bias = np.full(width, 1e-2), 1e-2
    for _ in range(s.steps):
        z_p = np.bincount(entries_p, w[at_p] * weight_p, len(positive)) + bias
        loss_u, grad_u, bias_u = unlabelled.clean_loss(w, bias)
        clean_risk = loss_u / total - prior * np.logaddexp(0, z_p).mean()
        clean_p = _sigmoid(z_p) * prior / len(positive)  # of the positives' share in the clean risk
        on_p = -_sigmoid(-z_p) * prior / len(positive)  # of the risk on positives
        grad_clean = grad_u / total - np.bincount(at_p, clean_p[entries_p] * weight_p, width)
        bias_clean = bias_u / total - clean_p.sum()
        if clean_risk >= -s.beta:
            grad = grad_clean + np.bincount(at_p, on_p[entries_p] * weight_p, width)
            g = bias_clean + on_p.sum()
        else:
            grad, g = -s.gamma * grad_clean, -s.gamma * bias_clean
        grad = np.where(usable, grad, 0)
        seen += grad * grad
        rate = s.rate / np.sqrt(seen)
        w -= rate * grad
        w = np.sign(w) * np.maximum(np.abs(w) - s.sparsity * rate, 0)
        seen_bias += g * g
        bias -= s.rate * g / np.sqrt(seen_bias)
    return Model(w.astype(np.float32), float(bias), prior)


class CorpusRows:
    """The unlabelled side as a stored table of word buckets (column ``at``), read by Spark.

    Each step is one job: tasks add up the loss and gradient of their rows and hand on one row
    per word they saw; the sums by word are at most ``2^bits`` rows at the driver.
    """

    def __init__(self, table: DataFrame):
        self.table = table.select("at")
        self.n = self.table.count()

    def __len__(self) -> int:
        return self.n

    def counts(self, width: int) -> np.ndarray:
        rows = self.table.select(F.explode("at").alias("f")).groupBy("f").count().toArrow()
        out = np.zeros(width, np.int64)
        out[rows.column("f").to_numpy()] = rows.column("count").to_numpy()
        return out

    def clean_loss(self, w: np.ndarray, bias: float) -> tuple[float, np.ndarray, float]:
        weights, width = w.astype(np.float64), len(w)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grad, loss, bias_grad = np.zeros(width), 0.0, 0.0
            for batch in batches:
                column = batch.column(0)
                at = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                entries = np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                part = _clean_loss(at, np.ones(len(at)), entries, len(column), weights, bias)
                loss, grad, bias_grad = loss + part[0], grad + part[1], bias_grad + part[2]
            f = np.flatnonzero(grad)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(([-1, -2], f)), pa.int32()), pa.array(np.concatenate(([loss, bias_grad], grad[f])))], names=["f", "g"]
            )

        summed = self.table.mapInArrow(run, "f int, g double").groupBy("f").agg(F.sum("g").alias("g")).toArrow()
        f, g = summed.column("f").to_numpy(), summed.column("g").to_numpy()
        grad = np.zeros(width)
        grad[f[f >= 0]] = g[f >= 0]
        return float(g[f == -1].sum()), grad, float(g[f == -2].sum())


def learn_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    settings: Settings | None = None,
) -> Model:
    """Train from toxic rows of ``labels`` and from all texts of ``docs`` without their labels.

    The class prior is the toxic share of the labelled rows (null labels and ids not counted).
    Both tables should hold training rows only. Every row of ``docs`` is unlabelled data, null
    texts as empty ones; an id of several rows is one toxic example (the text of least hash).
    Without toxic examples or without texts every score is low.
    """
    s = settings or Settings()
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).alias("y"))
    total, toxic = known.agg(F.count("*"), F.count(F.when(F.col("y") == 1, 1))).first()
    prior = toxic / total if total else 0.0
    words = WordBuckets(s.bits)
    found = docs.select(F.col(id_col).alias("id"), sparse_column(F.col(text_col), words).alias("f"))
    corpus = materialise(found.select("id", F.col("f.at").alias("at")), "toxicity-words")
    # At most twice max_positive ids, so a bounded broadcast; one row per id.
    ids = F.broadcast(hashed_sample(known.where("y = 1").select("id").distinct(), "id", s.max_positive))
    many = F.size("at") > s.max_features
    kept = F.filter("at", lambda x: F.pmod(F.xxhash64(x, F.lit("feature")), F.size("at")) < s.max_features)
    positive = (
        corpus.join(ids, "id")
        .groupBy("id")
        .agg(F.min_by("at", F.xxhash64("at")).alias("at"))
        .select(F.when(many, kept).otherwise(F.col("at")).alias("at"))
        .select(F.struct("at", F.transform("at", lambda _: F.lit(1.0).cast("float")).alias("weight")).alias("f"), F.lit(0).alias("n"))
    )
    return fit_nnpu(collect_rows(positive, "n")[0], CorpusRows(corpus), prior, s)


def toxicity(text: Column, model: Model) -> Column:
    """Score from 0 to 1; null and empty texts get the model's bias alone."""
    bits = int(len(model.weights)).bit_length() - 1

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = WordBuckets(bits)
        for batch in batches:
            yield pa.array([round(model.score(words(t or "")[0]), 6) for t in batch.to_pylist()], pa.float64())

    return run(text)
