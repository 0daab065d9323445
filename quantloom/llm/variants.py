"""Spelling variants: words one edit apart, found by probing edits against Bloom filters.

Every vocabulary word gets a blocked Bloom filter bit pattern in the shard of its length: one
block of 512 bits picked by its key, ``PROBE_BITS`` bits in it by a second mix of the key. Shards are built in
tasks and OR-ed together by Spark, then broadcast; their size is bounded by ``MAX_FILTER_BYTES``
whatever the vocabulary (a fuller filter only lets more false positives through). Each word then
probes its deletions and substitutions against the shard of the probe's length; insertions need
no probe, as they are the deletions of the longer word. Only positives are shuffled, to an exact
join with the vocabulary that removes the false ones, so every near pair is found and no pair
is kept that is not one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.hot import salted_join
from quantloom.session import materialise

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_BITS = 512
PROBE_BITS = 6
BITS_PER_WORD = 16
MAX_FILTER_BYTES = 64 << 20  # all shards together; the broadcast never exceeds it
PROBE_WORDS = 50_000  # words a probing task takes, about


def noisy(run: Column, doc_id: Column) -> Column:
    """A run with A-Z lower-cased; where 31 divides h = crc32("<doc_id>:<run>"), it loses its
    code point h % length. A null id reads as empty."""
    low = F.translate(run, UPPER, LOWER)
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), low).cast("binary"))
    at = h % F.char_length(low)
    cut = F.concat(F.substr(low, F.lit(1), at.cast("int")), F.substr(low, (at + 2).cast("int"), F.lit(1 << 30)))
    return F.when(h % 31 == 0, cut).otherwise(low)


def noisy_runs(text: Column, doc_id: Column) -> Column:
    """Runs of letters of a text, each made ``noisy``; a null text has no run."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(RUN), 0)
    return F.transform(runs, lambda run: noisy(run, doc_id))


def vocabulary(docs: DataFrame, min_chars: int = 7, min_count: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n)``: distinct noisy runs of at least ``min_chars`` code points found ``min_count`` times.

    A noisy edit only deletes, so only runs of at least ``min_chars`` letters can give words:
    ``RUN{min_chars,}`` finds exactly the maximal such runs (a shorter run fails at its start and
    at every later place). Runs are exploded first, so that the per-run work is a plain
    generated projection.
    """
    longer = f"{RUN[:-1]}{{{max(1, min_chars)},}}"
    runs = docs.select(
        F.col(id_col).alias("id"),
        F.explode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(longer), 0)).alias("run"),
    )
    words = runs.select(noisy(F.col("run"), F.col("id")).alias("word"))
    return (
        words.where(F.char_length("word") >= min_chars)
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_count)
    )


# Probe keys: a polynomial hash of code points modulo 2^64, so that the key of every deletion
# and substitution of a word follows from the word's prefix sums in a few vector operations;
# block and bits come from a SplitMix64 finish of it. Unequal strings with one key only add
# false positives, which the exact join removes.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CHUNK = 1 << 22  # probe keys a vector holds at most


def _mix(x: np.ndarray) -> np.ndarray:
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(length: int) -> np.ndarray:
    out = np.ones(max(length, 1), np.uint64)
    for k in range(1, length):
        out[k] = out[k - 1] * _BASE
    return out


def _codes(words: list[str], length: int) -> np.ndarray:
    """(words, length) code points plus one; all code points of runs are below 256."""
    raw = np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), length)
    return raw.astype(np.uint64) + np.uint64(1)


def _prefix(codes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        terms = codes * _powers(codes.shape[1])[None, :]
        return np.concatenate([np.zeros((len(codes), 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)], axis=1)


def _places(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block of each key and the (lane, bit) of its ``PROBE_BITS`` bits, shape (keys, PROBE_BITS)."""
    with np.errstate(over="ignore"):
        first = _mix(keys)
        second = _mix(first ^ np.uint64(0xD6E8FEB86659FD93))
    block = (first % np.uint64(blocks)).astype(np.int64)
    spots = np.stack([(second >> np.uint64(9 * i)) & np.uint64(BLOCK_BITS - 1) for i in range(PROBE_BITS)], axis=1)
    return block, (spots >> np.uint64(6)).astype(np.int64), (spots & np.uint64(63))


def _by_length(words) -> dict[int, list[int]]:
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    return groups


def _marks(blocks: dict[int, int]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            words = list(frame["word"])
            for length, at in _by_length(words).items():
                keys = _prefix(_codes([words[i] for i in at], length))[:, -1]
                block, lane, bit = _places(keys, blocks[length])
                marks = (np.uint64(1) << bit).view(np.int64)
                yield pd.DataFrame(
                    {
                        "length": length,
                        "block": np.repeat(block, PROBE_BITS),
                        "lane": lane.ravel(),
                        "bits": marks.ravel(),
                    }
                )

    return run


def build_filters(words: DataFrame) -> dict[int, np.ndarray]:
    """Blocked Bloom filter per word length: an array (blocks, 8) of 64-bit lanes.

    Blocks a shard gets: enough for ``BITS_PER_WORD`` bits a word, all shards scaled down
    together to at most ``MAX_FILTER_BYTES``. Marks are made in tasks and OR-ed by Spark; only
    the counts a length and the filters reach the driver.
    """
    sizes = {r["length"]: r["count"] for r in words.groupBy(F.char_length("word").alias("length")).count().collect()}
    wanted = {k: max(1, math.ceil(v * BITS_PER_WORD / BLOCK_BITS)) for k, v in sizes.items()}
    total = sum(wanted.values()) * BLOCK_BITS // 8
    scale = min(1.0, MAX_FILTER_BYTES / total) if total else 1.0
    blocks = {k: max(1, int(v * scale)) for k, v in wanted.items()}
    marks = words.select("word").mapInPandas(_marks(blocks), "length long, block long, lane long, bits long")
    merged = marks.groupBy("length", "block", "lane").agg(F.bit_or("bits").alias("bits"))
    filters = {k: np.zeros((v, BLOCK_BITS // 64), np.uint64) for k, v in blocks.items()}
    for r in merged.toLocalIterator():
        filters[r["length"]][r["block"], r["lane"]] = np.uint64(r["bits"] & ((1 << 64) - 1))
    return filters


def _hits(shard: np.ndarray | None, keys: np.ndarray) -> np.ndarray:
    if shard is None:
        return np.zeros(keys.shape, bool)
    flat = keys.ravel()
    block, lane, bit = _places(flat, len(shard))
    found = np.ones(len(flat), bool)
    for i in range(PROBE_BITS):
        found &= ((shard[block, lane[:, i]] >> bit[:, i]) & np.uint64(1)).astype(bool)
    return found.reshape(keys.shape)


def _probe(filters, letters: str, min_chars: int):
    """Deletions and substitutions of each word whose keys the filter of their length holds."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shards = filters.value
        swap = np.frombuffer(letters.encode("latin-1"), np.uint8).astype(np.uint64) + np.uint64(1)
        for frame in frames:
            words, counts = list(frame["word"]), frame["n"].to_numpy()
            out: dict[str, list] = {"source": [], "target": [], "deleted": [], "source_n": []}
            for length, at in _by_length(words).items():
                powers = _powers(length)
                step = max(1, _CHUNK // max(1, length * (len(swap) + 1)))
                for start in range(0, len(at), step):
                    part = at[start : start + step]
                    codes = _codes([words[i] for i in part], length)
                    prefix = _prefix(codes)
                    whole = prefix[:, -1]
                    with np.errstate(over="ignore"):
                        if length - 1 >= min_chars:
                            cut = prefix[:, :-1] + (whole[:, None] - prefix[:, 1:]) * _INVERSE
                            for r, i in zip(*np.nonzero(_hits(shards.get(length - 1), cut)), strict=True):
                                w = words[part[r]]
                                out["source"].append(w)
                                out["target"].append(w[:i] + w[i + 1 :])
                                out["deleted"].append(True)
                                out["source_n"].append(int(counts[part[r]]))
                        if length >= min_chars:
                            made = whole[:, None, None] + (swap[None, None, :] - codes[:, :, None]) * powers[None, :, None]
                            same = swap[None, None, :] == codes[:, :, None]
                            found = _hits(shards.get(length), made) & ~same
                            for r, i, c in zip(*np.nonzero(found), strict=True):
                                w = words[part[r]]
                                out["source"].append(w)
                                out["target"].append(w[:i] + letters[c] + w[i + 1 :])
                                out["deleted"].append(False)
                                out["source_n"].append(int(counts[part[r]]))
            yield pd.DataFrame(out)

    return run


def near_pairs(words: DataFrame, min_chars: int = 7) -> DataFrame:
    """``(word, near, near_n)`` both ways for every pair of vocabulary words one edit apart."""
    words = materialise(words.select("word", "n"), "variant-words")
    filters = build_filters(words)
    # Letters that words use: at most the letters of a run, so a bounded list.
    used = words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct()
    letters = "".join(sorted(r[0] for r in used.collect()))
    shared = words.sparkSession.sparkContext.broadcast(filters)
    # Tasks of a bounded number of words, however few files the vocabulary was stored in.
    spread = words.repartition(max(1, math.ceil(words.count() / PROBE_WORDS)), "word")
    found = materialise(
        spread.mapInPandas(_probe(shared, letters, min_chars), "source string, target string, deleted boolean, source_n long"),
        "variant-positives",
    ).dropDuplicates(["source", "target"])
    counts = found.groupBy(F.col("target").alias("word")).agg(F.count("*").alias("probes"))
    exact = salted_join(
        found.withColumnRenamed("target", "word"), words.join(counts, "word"), ["word"], "probes", F.xxhash64("source")
    )
    forward = exact.select(F.col("source").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    backward = exact.where("deleted").select("word", F.col("source").alias("near"), F.col("source_n").alias("near_n"))
    return forward.unionByName(backward)


def variant_groups(docs: DataFrame, min_chars: int = 7, min_count: int = 2, ratio: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every vocabulary word.

    form: the near word of largest n (ties: least in code-point order) if that n is at least
    ``ratio`` times the word's, else null; root: forms followed to the end (the word itself if it
    has no form). Forms raise n at least ``ratio`` times, so chains are short and have no cycle;
    they are followed by pointer doubling. Empty table or no word: no row.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2, so that forms cannot cycle")
    words = materialise(vocabulary(docs, min_chars, min_count, id_col, text_col), "variant-vocabulary")
    pairs = near_pairs(words, min_chars)
    best = pairs.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("neg"), F.col("near").alias("near"))).alias("best")
    )
    judged = materialise(
        words.join(best, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(-F.col("best.neg") >= ratio * F.col("n"), F.col("best.near")).alias("form"),
            F.when(-F.col("best.neg") >= ratio * F.col("n"), -F.col("best.neg")).alias("form_n"),
        ),
        "variant-forms",
    )
    # Pointer doubling: every round, each word jumps to the root-so-far of its root-so-far.
    step = judged.select("word", F.coalesce("form", "word").alias("root"))
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        fan = step.groupBy("root").agg(F.count("*").alias("fan"))
        moved = salted_join(step, ahead.join(fan, "root"), ["root"], "fan", F.xxhash64("word")).select(
            "word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")
        )
        moved = materialise(moved, "variant-roots")
        if not moved.where("moved").limit(1).count():
            step = moved.drop("moved")
            break
        step = moved.drop("moved")
    return judged.join(step, "word").select("word", "form", "root", "n", "n_near", "form_n")
