"""Language identification with hyperdimensional letter n-gram profiles.

Every letter has a random vector of +1 and -1. An n-gram binds (multiplies) its letters'
vectors, each rotated by its place from the end; a text bundles (adds) its n-grams. A language's
prototype is the bundle of its training texts, and the text goes to the prototype with the
greatest cosine. Bundling is a sum, so prototypes are made from n-gram counts that Spark
adds up over all training texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UND = "und"
SYMBOLS = 48  # 0 is whatever is no letter, 1-26 are a-z, other letters share the rest
_ROWS = 4096  # n-grams whose vectors are held at once
_SCALE = 1 << 20  # a text's n-gram shares are added as whole numbers of this


def _symbol(code: int) -> int:
    char = chr(code).lower()[0] if not 0xD800 <= code < 0xE000 else " "
    if "a" <= char <= "z":
        return ord(char) - 96
    return 27 + ord(char) * 2654435761 % (1 << 32) * (SYMBOLS - 27) // (1 << 32) if char.isalpha() else 0


_TABLE: list[np.ndarray] = []


def symbols(text: str) -> np.ndarray:
    """Letter symbols of a text, runs of anything else as one 0, and 0 at both ends."""
    if not _TABLE:
        _TABLE.append(np.array([_symbol(c) for c in range(65536)], np.int64))
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    found = _TABLE[0][np.minimum(codes, 65535)]
    if len(codes) and codes.max() > 65535:
        rest = np.nonzero(codes > 65535)[0]
        found[rest] = [_symbol(int(c)) for c in codes[rest]]
    found = np.concatenate(([0], found, [0]))
    return found[np.concatenate(([True], (found[1:] != 0) | (found[:-1] != 0)))]


def ngrams(text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams as numbers, and how often each occurs; none without a letter."""
    at = symbols(text)
    if len(at) < n or not at.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = len(at) - n + 1
    key = at[:size]
    for k in range(1, n):
        key = key * SYMBOLS + at[k : k + size]
    return np.unique(key, return_counts=True)


@dataclass
class Profiles:
    """Prototypes of languages and all that is needed to make a text's vector."""

    langs: list[str]
    prototypes: np.ndarray
    n: int
    dims: int
    seed: int
    sharpness: float

    def letters(self) -> np.ndarray:
        """Letter vectors rotated for each place of an n-gram: (place, symbol, dimension)."""
        base = np.random.default_rng(self.seed).choice(np.array([-1, 1], np.int8), (SYMBOLS, self.dims))
        return np.stack([np.roll(base, self.n - 1 - k, axis=1) for k in range(self.n)])

    def bundle(self, grams: np.ndarray, weights: np.ndarray, letters: np.ndarray) -> np.ndarray:
        out = np.zeros(self.dims)
        for at in range(0, len(grams), _ROWS):
            rest = grams[at : at + _ROWS]
            bound = np.ones((len(rest), self.dims), np.int8)
            for k in range(self.n - 1, -1, -1):
                bound *= letters[k][rest % SYMBOLS]
                rest = rest // SYMBOLS
            out += weights[at : at + _ROWS].astype(np.float32) @ bound.astype(np.float32)
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(size > 0, size, 1)


def learn_profiles(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    n: int = 3,
    dims: int = 512,
    seed: int = 7,
    sharpness: float = 12.0,
) -> Profiles:
    """Prototypes from all rows with a text and a language; every text counts alike.

    At most ``SYMBOLS ** n`` counts a language reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams, found = ngrams(text, n)
                if len(grams):
                    if lang not in sums:
                        sums[lang] = np.zeros(SYMBOLS**n, np.int64)
                    sums[lang][grams] += np.rint(found / found.sum() * _SCALE).astype(np.int64)
        for lang, have in sums.items():
            grams = np.nonzero(have)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams)), pa.array(grams), pa.array(have[grams])], names=["lang", "gram", "n"]
            )

    named = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = (
        named.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
        .mapInArrow(count, "lang string, gram bigint, n bigint")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    made = Profiles(sorted(set(rows["lang"])), np.zeros((0, dims)), n, dims, seed, sharpness)
    letters = made.letters()
    by_lang = [rows[rows["lang"] == lang].sort_values("gram") for lang in made.langs]
    if by_lang:
        made.prototypes = _unit(np.stack([made.bundle(r["gram"].to_numpy(), r["n"].to_numpy() / _SCALE, letters) for r in by_lang]))
    return made


def predict_lang(text: Column, profiles: Profiles) -> Column:
    """Struct ``lang_pred`` and ``score``, a softmax of the cosines.

    ``und`` with score 0 for a null text, one without a letter, or without any learned
    language; of equal cosines the first language in alphabetical order.
    """
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        letters = profiles.letters()
        for batch in batches:
            names, scores = [], []
            for text in batch.to_pylist():
                grams, found = ngrams(text or "", profiles.n)
                if not len(grams) or not profiles.langs:
                    names.append(UND)
                    scores.append(0.0)
                    continue
                near = profiles.prototypes @ _unit(profiles.bundle(grams, found, letters))
                best = int(np.argmax(np.round(near, 9)))
                names.append(profiles.langs[best])
                scores.append(round(float(1 / np.exp(profiles.sharpness * (near - near[best])).sum()), 6))
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], fields=list(kind))

    return run(text)
