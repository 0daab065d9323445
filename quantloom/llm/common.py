"""Small helpers that several operators of this package share."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.session import ship_code

_GROUP_CHARS = 500_000  # texts of about so many characters are encoded together
# White space on which Python and the tokenizers' patterns disagree.
_ODD_SPACE = re.compile("[\x1c-\x1f]")


# Bytes of a batch for Python, so that very long texts make shorter batches.
BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> None:
    """Make task functions importable on executors and bound the batches they get."""
    ship_code(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


class ChunkCache:
    """Ids of text chunks, so that a tokenizer sees each frequent chunk once.

    ``cut`` cuts a text where no token can cross, and ``learn`` maps new chunks to their packed ids. At
    ``size`` chunks the newer half goes: frequent chunks come early and stay. Chunks longer than
    ``longest`` are not kept. Both bound the cache's memory.
    """

    def __init__(
        self,
        cut: Callable[[str], list[str]],
        learn: Callable[[list[str]], list[bytes]],
        size: int = 600_000,
        longest: int = 64,
    ):
        self.cut, self.learn, self.size, self.longest = cut, learn, size, longest
        self.known: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text, little-endian 32-bit."""
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= _GROUP_CHARS:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str]) -> Iterator[np.ndarray]:
        known = self.known
        ready, new = [], {}  # a dict, as its order makes the cache the same in every run
        for text in texts:
            chunks = self.cut(text)
            found = list(map(known.get, chunks))
            gaps = [(i, chunks[i]) for i, f in enumerate(found) if f is None]
            new.update((c, b"") for _, c in gaps)
            ready.append((found, gaps))
        new = dict(zip(new, self.learn(list(new)), strict=True))
        known.update((c, ids) for c, ids in new.items() if len(c) <= self.longest)
        if len(known) > self.size:
            for chunk in list(islice(known, self.size // 2, None)):
                del known[chunk]
        for found, gaps in ready:
            for i, chunk in gaps:
                found[i] = new[chunk]
            yield np.frombuffer(b"".join(found), "<u4")


WHOLE = "\0"  # before a chunk that is to be encoded as it stands

_SPACED = re.compile(r"\s*\S+|\s+").findall


def words(text: str) -> list[str]:
    """Words, for tokenizers that lower-case and drop white space.

    In texts of Latin letters lower-casing first changes nothing but the number of chunks.
    """
    if WHOLE in text:
        return [WHOLE + w for w in text.split()]
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text.split()
    return text.lower().split()


def spaced_words(text: str) -> list[str]:
    """Words with the white space before them, for byte-level tokenizers.

    Their tokens do not go from a word on to white space. Where words stand apart by one space or
    line end each and by nothing else, as most do, a chunk is a word alone (a space before it) or a line end and
    a word, which plain splitting finds.
    """
    if WHOLE not in text and " ".join(text.split()) == text.replace("\n", " "):
        chunks = text.replace("\n", " \n").split(" ")
        chunks[0] = WHOLE + chunks[0]
        return chunks
    return [WHOLE + c for c in _SPACED(text)]


def spell(chunk: str) -> str:
    return chunk[1:] if chunk[:1] == WHOLE else chunk if chunk[:1] == "\n" else " " + chunk


# Words of Latin letters (of one or two bytes) and a mark after them: one token run each, whatever
# stands around them, in all patterns used here; no letter here changes under composition.
_PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]?)").fullmatch


def _byte_letters() -> list[str]:
    """The letter that byte-level models write for a byte: itself if it shows, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


def cut_at_added(cut: Callable[[str], list[str]], strings: list[str]) -> Callable[[str], list[str]]:
    """``cut`` for what stands between ``strings``, which are looked for in the raw text, the longest first."""
    apart = re.compile(f"({'|'.join(map(re.escape, sorted(strings, key=len, reverse=True)))})").split

    def run(text: str) -> list[str]:
        if not any(s in text for s in strings):
            return cut(text)
        return [c for k, part in enumerate(apart(text)) if part for c in ([WHOLE + part] if k % 2 else cut(part))]

    return run


@lru_cache(maxsize=4)
def chunked_tokenizer(path: str, cut: Callable[[str], list[str]], lower: bool = False, special: bool = False) -> ChunkCache:
    """A tokenizers file behind a chunk cache.

    Strings of special tokens in texts are plain text, or with ``special`` their tokens, which is the library's
    default. A text, or what lies between two such tokens, is one chunk if it has white space that the tokenizers'
    patterns treat differently from Python's.
    Plain words go straight to the library's model, all else through its whole course.
    ``lower`` says that the tokenizer lower-cases and drops white space. A Python worker keeps the tokenizer, and what
    the cache has learned, from task to task.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task per core already
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # as chunks may be lower-cased, special tokens are found before
    added = tokenizer.get_added_tokens_decoder() if special else {}
    if any(t.normalized or t.single_word or t.lstrip or t.rstrip or not t.special for t in added.values()):
        raise ValueError("An added token of the file is not to be found in raw text as it stands")
    tokens = {WHOLE + t.content: array("I", [i]).tobytes() for i, t in added.items()}

    def chunks_of(text: str) -> list[str]:
        return [WHOLE + text] if _ODD_SPACE.search(text) else cut(text)

    model, letters = tokenizer.model, dict(enumerate(_byte_letters()))
    gap = letters[ord(" ")]

    def plain(word: str) -> list[int]:
        shown = word.strip().lower() if lower else word
        shown = shown.replace(" ", gap) if shown.isascii() else shown.encode().decode("latin-1").translate(letters)
        return [t.id for t in model.tokenize(shown)]

    @lru_cache(maxsize=16)
    def mark(sign: str) -> bytes:
        return array("I", plain(sign)).tobytes()

    def learn(chunks: list[str]) -> list[bytes]:
        out, rest = [b""] * len(chunks), []
        for i, chunk in enumerate(chunks):
            if chunk in tokens:
                out[i] = tokens[chunk]
                continue
            text = spell(chunk)
            word = _PLAIN(text)
            if word is None:
                rest.append((i, text))
            elif word[2]:
                stem = cache.known.get(chunk[:-1])
                out[i] = (array("I", plain(word[1])).tobytes() if stem is None else stem) + mark(word[2])
            else:
                out[i] = array("I", plain(text)).tobytes()
        whole = tokenizer.encode_batch_fast([t for _, t in rest], add_special_tokens=False) if rest else []
        for (i, _), found in zip(rest, whole, strict=True):
            out[i] = array("I", found.ids).tobytes()
        return out

    cache = ChunkCache(cut_at_added(chunks_of, [t.content for t in added.values()]) if added else chunks_of, learn)
    return cache
