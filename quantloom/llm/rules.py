"""Quality rules by distribution divergence from language references.

A document's character-class histogram and its histogram over a language's common words are
compared with the means of that language by Jensen-Shannon distance (base 2, 0 to 1). The
nearest language counts, so a missing or wrong language code does no harm. Short texts
have noisy histograms, so each comparison has a length below which it does not judge.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.session import materialise

SPACE = np.array([9, 10, 11, 12, 13, 32])
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_EDGE = b".,;:!?\"'()[]#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "symbol", "punctuation", "space", "line_end", "control", "other")


def _classes() -> np.ndarray:
    """Class of every UTF-8 byte; bytes inside a character have none (-1)."""
    of = np.full(256, CLASSES.index("punctuation"))
    of[:32] = of[127] = CLASSES.index("control")
    of[ord("a") : ord("z") + 1], of[ord("A") : ord("Z") + 1] = 0, 1
    of[ord("0") : ord("9") + 1] = 2
    of[SYMBOLS] = 3
    of[SPACE], of[10] = 5, 6
    of[128:192], of[192:] = -1, CLASSES.index("other")
    return of


_CLASS_OF = _classes()
_PICK = np.array([_CLASS_OF == k for k in range(len(CLASSES))], float)


@dataclass
class Thresholds:
    """Limits of the verdict. A distance above its limit rejects, if the text is long enough."""

    min_words: int = 50
    repeat_percent: int = 50
    char_distance: float = 0.28
    char_min_chars: int = 200
    word_distance: float = 0.3
    word_slack: float = 0.6  # over the root of the number of words, the noise of short texts
    word_min_words: int = 50


@dataclass
class References:
    """Per language: mean class shares, and its common words with their shares of all words."""

    langs: list[str] = field(default_factory=list)
    chars: np.ndarray = field(default_factory=lambda: np.zeros((0, len(CLASSES))))
    words: list[dict[bytes, float]] = field(default_factory=list)


def byte_counts(raw: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(raw, np.uint8), minlength=256)


def class_shares(counts: np.ndarray) -> np.ndarray:
    whole = _PICK @ counts
    return whole / max(1.0, whole.sum())


def plain_words(words: Counter) -> Counter:
    """Counts of words without case (A-Z) and punctuation around them."""
    found: Counter = Counter()
    for word, n in words.items():
        found[word.lower().strip(_EDGE)] += n
    return found


def repeat_words(words: list[bytes], window: int = 3) -> int:
    """Words that lie in a window of words found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    at = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    key = at[:n]
    for k in range(1, window):
        if int(key.max()) * len(ids) > 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(ids) + at[k : k + n]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(window):
        covered[k : k + n] |= twice
    return int(covered.sum())


def base_counts(raw: bytes, words: list[bytes], counts: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    chars = int(counts[:128].sum() + counts[192:].sum() - counts[SPACE].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), chars, int(counts[SYMBOLS].sum()), len(lines) - len(set(lines)), repeat_words(words)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance along the last axis, base 2."""
    m = (p + q) / 2

    def part(x: np.ndarray) -> np.ndarray:
        ratio = np.where(x > 0, x / np.where(m > 0, m, 1), 1)
        return (x * np.log2(ratio)).sum(-1) / 2

    return np.sqrt(np.clip(part(p) + part(q), 0, 1))


def distances(counts: np.ndarray, words: Counter, refs: References) -> tuple[float, float]:
    """Distances to the nearest language, of character classes and of common words."""
    if not refs.langs:
        return 0.0, 0.0
    by_class = js_distance(class_shares(counts), refs.chars)
    n = max(1, sum(words.values()))
    by_word = []
    for common in refs.words:
        q = np.array([*common.values(), 0.0])
        p = np.array([*[words.get(w, 0) / n for w in common], 0.0])
        p[-1], q[-1] = max(0.0, 1 - p.sum()), max(0.0, 1 - q.sum())
        by_word.append(float(js_distance(p, q)))
    return float(by_class.min()), min(by_word)


FIELDS = [
    ("n_words", "bigint", pa.int64()),
    ("word_chars", "bigint", pa.int64()),
    ("n_symbols", "bigint", pa.int64()),
    ("n_dup_lines", "bigint", pa.int64()),
    ("n_repeat_words", "bigint", pa.int64()),
    ("base_failed", "boolean", pa.bool_()),
    ("char_distance", "double", pa.float64()),
    ("word_distance", "double", pa.float64()),
    ("kept", "boolean", pa.bool_()),
]


def judge(raw: bytes, refs: References, limit: Thresholds) -> tuple:
    counts, words = byte_counts(raw), raw.split()
    base = base_counts(raw, words, counts)
    failed = base[0] < limit.min_words or 100 * base[4] > limit.repeat_percent * base[0]
    by_class, by_word = distances(counts, plain_words(Counter(words)), refs)
    odd = by_class > limit.char_distance and base[1] >= limit.char_min_chars
    odd = odd or (
        base[0] >= limit.word_min_words and by_word > limit.word_distance + limit.word_slack / base[0] ** 0.5
    )
    return *base, failed, by_class, by_word, not failed and not odd


def verdict(text: Column, refs: References, limit: Thresholds | None = None) -> Column:
    """Struct of ``FIELDS`` per text; a null text has no words and so fails the base rules."""
    limit = limit or Thresholds()

    @F.arrow_udf("struct<" + ",".join(f"{n}:{t}" for n, t, _ in FIELDS) + ">")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [judge(t or b"", refs, limit) for t in batch.to_pylist()]
            columns = zip(*rows, strict=True) if rows else [[]] * len(FIELDS)
            yield pa.StructArray.from_arrays(
                [pa.array(c, kind) for c, (_, _, kind) in zip(columns, FIELDS, strict=True)], names=[n for n, _, _ in FIELDS]
            )

    return run(text.cast("binary"))


_FLUSH = 300_000  # word counts that a task holds before it hands them on
_SCALE = 1 << 24  # shares are summed as whole numbers, so that their order does not matter


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums per language: (lang, kind, key, n) of classes, documents and words."""
    sums: dict[str, Counter] = defaultdict(Counter)
    seen: dict[str, Counter] = defaultdict(Counter)  # words as they stand

    def rows() -> pa.RecordBatch:
        for lang, words in seen.items():
            for word, n in plain_words(words).items():
                sums[lang][b"w" + word] += n
        flat = [(lang, key, n) for lang, found in sums.items() for key, n in found.items()]
        sums.clear()
        seen.clear()
        columns = list(zip(*flat, strict=True)) if flat else [[], [], []]
        kinds = (pa.string(), pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["lang", "key", "n"]
        )

    limit = Thresholds()
    for batch in batches:
        for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = raw.split()
            if len(words) < limit.min_words:
                continue
            found = sums[lang]
            for k, share in enumerate(class_shares(byte_counts(raw))):
                found[b"c%d" % k] += round(share * _SCALE)
            found[b"d"] += 1
            found[b"n"] += len(words)
            seen[lang].update(words)
        if sum(map(len, seen.values())) > _FLUSH:
            yield rows()
    yield rows()


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", share: float = 0.004) -> References:
    """Language references from all documents that name a language and are long enough.

    A word is common in a language if it makes up ``share`` of its words, so a language has
    at most ``1 / share`` of them; only these and the class sums reach the driver.
    """
    named = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sums = (
        named.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("binary").alias("text"))
        .mapInArrow(_gather, "lang string, key binary, n bigint")
        .groupBy("lang", "key")
        .agg(F.sum("n").alias("n"))
    )
    sums = materialise(sums, "reference-counts")
    heads = sums.where("substr(key, 1, 1) <> x'77'").collect()  # 119 is w: the rest are classes and totals
    totals = {r.lang: r.n for r in heads if bytes(r.key) == b"n"}
    sizes = sums.where("key = x'6E'").select("lang", F.col("n").alias("total"))
    common = sums.where("substr(key, 1, 1) = x'77'").join(F.broadcast(sizes), "lang").where(f"n >= {share} * total").collect()
    found = References(sorted(totals))
    docs_of = {r.lang: r.n for r in heads if bytes(r.key) == b"d"}
    found.chars = np.zeros((len(found.langs), len(CLASSES)))
    for r in heads:
        if bytes(r.key).startswith(b"c"):
            found.chars[found.langs.index(r.lang), int(bytes(r.key)[1:])] = r.n / _SCALE / docs_of[r.lang]
    found.words = [{bytes(r.key)[1:]: r.n / totals[lang] for r in sorted(common, key=lambda r: bytes(r.key)) if r.lang == lang} for lang in found.langs]
    return found
