"""Homomorphic multiset fingerprints of documents, in SQL functions only.

A document is the multiset of its paragraphs. They are its lines, and a long line is not one
unit but ends at each sentence end. A paragraph is hashed to a wide vector of
0 and 1, and the fingerprint is the sum of its paragraphs' vectors modulo a power of two.
So the order of paragraphs does not matter, and adding or removing one adds or subtracts its
vector. Lanes have 30 bits, two to a 64-bit word and 32 apart, so no sum of two words overflows,
and one text, which has fewer than 2 ** 31 bytes, cannot wrap a lane. As text, lanes are added up
16 bits apart, four to a word modulo 2 ** 64.

Read as -1 and 1, the lanes of the difference of two fingerprints have a mean square near the
number of paragraphs by which the multisets differ, which gives the likeness.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.operators.ordering import with_row_id

LANE_BITS, LANE_STEP = 30, 32
LANES_PER_WORD = 64 // LANE_STEP
SHOWN_BITS = 16  # between lanes of a word as text
_LANE = (1 << LANE_BITS) - 1
_ONES, _LANES, _ABOVE = (x << LANE_STEP | x for x in (1, _LANE, _LANE + 1))


def paragraphs(text: Column) -> Column:
    """Lines of a text, cut after ". ", "! " and "? ", without blank ones; null has none."""
    cut = F.coalesce(text, F.lit(""))
    for mark in ".!?":
        cut = F.replace(cut, F.lit(mark + " "), F.lit(mark + "\n"))
    return F.filter(F.split(cut, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\x0c\r"))) > 0)


def vector_words(hashes: Column, words: int) -> Column:
    """Array of ``2 * words`` sums, then the number of paragraphs.

    ``hashes`` is an array with one array per paragraph of ``words / 16`` 64-bit hashes. A sum
    takes bits i and i + 32 of a hash, so every bit of it becomes a lane.
    """

    def total(i: int) -> Column:
        return F.aggregate(
            hashes,
            F.lit(0).cast("bigint"),
            lambda acc, h: acc + F.shiftrightunsigned(h[i // LANE_STEP], i % LANE_STEP).bitwiseAND(F.lit(_ONES)),
        )

    return F.array(*[total(i) for i in range(2 * words)], F.size(hashes).cast("bigint"))


def paragraph_hashes(text: Column, words: int = 32) -> Column:
    """Per paragraph its ``words / 16`` hashes; each is 64 lanes of the vector."""
    if words % SHOWN_BITS:
        raise ValueError("words must be a multiple of 16")
    return F.transform(
        paragraphs(text), lambda p: F.array(*[F.xxhash64(p, F.lit(k)) for k in range(words // SHOWN_BITS)])
    )


def _sums(vector: Column) -> Column:
    return F.slice(vector, 1, F.size(vector) - 1)


def _count(vector: Column) -> Column:
    return F.element_at(vector, -1)


def add(a: Column, b: Column) -> Column:
    """Fingerprint of both multisets together."""
    sums = F.zip_with(_sums(a), _sums(b), lambda x, y: (x + y).bitwiseAND(F.lit(_LANES)))
    return F.concat(sums, F.array(_count(a) + _count(b)))


def subtract(a: Column, b: Column) -> Column:
    """Fingerprint without the paragraphs of the second, which must be in the first."""
    sums = F.zip_with(_sums(a), _sums(b), lambda x, y: (x.bitwiseOR(F.lit(_ABOVE)) - y).bitwiseAND(F.lit(_LANES)))
    return F.concat(sums, F.array(_count(a) - _count(b)))


def _lane(word: Column, k: int) -> Column:
    return F.shiftrightunsigned(word, k * LANE_STEP).bitwiseAND(F.lit(_LANE))


def as_hex(vector: Column) -> Column:
    """The whole vector as text, 16 hex digits a word.

    A word has the lanes of bits i, i + 16, i + 32 and i + 48 of a hash; what a lane has above
    16 bits goes on to the next, as in a sum modulo 2 ** 64.
    """

    def shown(i: Column) -> Column:
        at = F.floor(i / SHOWN_BITS).cast("int") * LANE_STEP + i % SHOWN_BITS
        even, odd = vector[at], vector[at + SHOWN_BITS]
        word = carry = F.lit(0).cast("bigint")
        for k, lane in enumerate((_lane(even, 0), _lane(odd, 0), _lane(even, 1), _lane(odd, 1))):
            full = lane + carry
            word = word.bitwiseOR(F.shiftleft(full.bitwiseAND(F.lit((1 << SHOWN_BITS) - 1)), k * SHOWN_BITS))
            carry = F.shiftrightunsigned(full, SHOWN_BITS)
        return word

    words = F.transform(F.sequence(F.lit(0), F.floor(F.size(vector) / 2).cast("int") - 1), shown)
    every = F.concat(words, F.array(_count(vector)))
    return F.array_join(F.transform(every, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def _square(value: Column) -> Column:
    """Square of twice a lane less a count, of which the residue next to 0 is taken."""
    half = F.lit(1 << LANE_BITS)
    return F.pow(((value + half).bitwiseAND(F.lit((2 << LANE_BITS) - 1)) - half).cast("double"), 2.0)


def _squares(words: Column, count: Column) -> Column:
    """Mean square of the lanes read as -1 and 1: each is twice its sum less the count."""

    def one(w: Column) -> Column:
        return reduce(lambda a, b: a + b, [_square(2 * _lane(w, k) - count) for k in range(LANES_PER_WORD)])

    total = F.aggregate(words, F.lit(0.0), lambda acc, w: acc + one(w))
    return total / (F.size(words) * LANES_PER_WORD)


def _signed_squares(a: Column, b: Column) -> Column:
    """Mean square of the difference, lane by lane and modulo the lane's power."""
    n = F.size(a) - 1
    gap = _count(a) - _count(b)
    pairs = F.arrays_zip(_sums(a).alias("x"), _sums(b).alias("y"))

    def one(p: Column) -> Column:
        lanes = [_square(2 * (_lane(p["x"], k) - _lane(p["y"], k)) - gap) for k in range(LANES_PER_WORD)]
        return reduce(lambda u, v: u + v, lanes)

    return F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + one(p)) / (n * LANES_PER_WORD)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the share of paragraphs that two documents have in common, estimated.

    1 for equal fingerprints, two of empty documents too. With 128 lanes the standard error
    is about an eighth of the share that differs.
    """
    whole = _squares(_sums(a), _count(a)) + _squares(_sums(b), _count(b))
    raw = F.when(a == b, F.lit(1.0)).when(whole == 0, F.lit(0.0)).otherwise(1.0 - _signed_squares(a, b) / whole)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 6)


def with_fingerprint(df: DataFrame, text: Column, name: str, words: int = 32) -> DataFrame:
    """Add the fingerprint vector of a text; a column ``name`` is replaced.

    The hashes are a step of their own, as every word of the vector reads them.
    """
    return df.withColumn(name, paragraph_hashes(text, words)).withColumn(name, vector_words(F.col(name), words))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 32) -> DataFrame:
    """Fingerprints of documents, of their edited texts, and their likeness.

    In an edited text the last ``n_chars div 2`` code points give way to the first as many of
    the next document's text (all of it, if shorter). The next document is that with the next
    lower id; after the lowest, null if there is one, comes the highest. Rows with the same id
    have the same next document, and of several rows with the next id the one whose
    text begins least is taken. A null text is empty; an empty table gives no rows.
    """
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    ids = docs.groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.expr(f"char_length(coalesce(`{text_col}`, '')) div 2")).alias("want")
    )
    # Only ids are put in order; texts meet their neighbours by key. Vectors are made after the joins, as they take
    # more room in shuffles than many a text.
    placed = with_row_id(ids, ["id"], "place")
    n = F.lit(ids.count())
    lower = placed.select(F.col("id").alias("next_id"), "place")
    asks = (
        placed.select(F.col("id").alias("for_id"), "want", F.pmod(F.col("place") - 1, n).alias("place"))
        .join(lower, "place")
        .select("for_id", "next_id", "want")
    )
    pieces = (
        with_fingerprint(own.join(asks, own["id"].eqNullSafe(asks["next_id"])), F.col("text"), "vector", words)
        .groupBy("for_id")
        .agg(F.min(F.struct(F.substring(F.col("text"), F.lit(1), F.col("want").cast("int")).alias("piece"), "vector")).alias("next"))
    )
    both = own.join(pieces, own["id"].eqNullSafe(pieces["for_id"])).select(
        "id", "text", F.char_length("text").alias("n"), F.col("next.piece").alias("piece"), F.col("next.vector").alias("next_vector")
    )
    half = F.expr("n div 2").cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n") - half), F.substring(F.col("piece"), F.lit(1), half))
    both = both.select("id", "n", "text", "next_vector", edited.alias("edited"))
    both = with_fingerprint(both, F.col("text"), "vector", words)
    return with_fingerprint(both, F.col("edited"), "edited_vector", words).select(
        F.col("id").alias(id_col),
        F.col("n").cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_hex(F.col("vector")).alias("fingerprint"),
        as_hex(F.col("edited_vector")).alias("edited_fingerprint"),
        likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"),
        likeness(F.col("vector"), F.col("next_vector")).alias("near_next"),
    )
