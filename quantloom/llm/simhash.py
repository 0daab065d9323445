"""SimHash near-duplicates with multi-index hashing.

Fingerprints are cut in segments. Two fingerprints within ``max_bits`` differ by at most
``max_bits // segments`` bits in one segment, so the segment values that occur are looked
up in each other's small Hamming balls, the fingerprints below matching values are
fetched and their whole distance is verified. Segment values, not fingerprints or
documents, are probed: copies and near copies share them, so a large group costs few probes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.components import components
from quantloom.session import materialise

BITS = 64
_HASH_BLOCK = 65_536


def fingerprint(text: bytes | None, shingle: int, seed: int) -> int:
    """SimHash of the text's word shingles as a signed 64-bit number; 0 without a word.

    ``bytes.lower`` and ``bytes.split`` know exactly A-Z and the ASCII white space.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    spans = list(zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True))
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _HASH_BLOCK):
        hashes = np.array([digest(flat[a:b], seed) for a, b in spans[at : at + _HASH_BLOCK]], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def simhash(text: Column, shingle: int = 3, seed: int = 42) -> Column:
    """Fingerprint column (bigint); whole texts, whatever their length."""

    @F.arrow_udf("bigint")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([fingerprint(t, shingle, seed) for t in batch.to_pylist()], pa.int64())

    return run(text.cast("binary"))


def _masks(width: int, radius: int) -> list[int]:
    """XOR masks of the Hamming ball without its centre, as signed 64-bit numbers."""
    made = [sum(1 << b for b in bits) for r in range(1, radius + 1) for bits in combinations(range(width), r)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in made]


def spanning_links(x: np.ndarray, y: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links ``(node, root)`` that connect all of x and y that lie within ``max_bits``.

    Every member of a linked set gets one link to the set's least member, so that their
    number stays below the number of members, however dense the set is.
    """
    nodes, where = np.unique(np.concatenate((x, y)), return_inverse=True)
    near = np.bitwise_count(x.view(np.uint64)[:, None] ^ y.view(np.uint64)[None, :]) <= max_bits
    i, j = np.nonzero(near)
    a, b = where[i], where[len(x) + j]
    a, b = a[a != b], b[a != b]
    if not len(a):
        return []
    label = np.arange(len(nodes))
    while True:
        was = label.copy()
        np.minimum.at(label, a, was[b])
        np.minimum.at(label, b, was[a])
        label = label[label]
        if np.array_equal(label, was):
            break
    moved = np.nonzero(label != np.arange(len(nodes)))[0]
    return list(zip(nodes[moved].tolist(), nodes[label[moved]].tolist(), strict=True))


def _verified(x: Column, y: Column, max_bits: int) -> Column:
    @F.arrow_udf("array<struct<node:bigint,root:bigint>>")
    def run(xs: pa.Array, ys: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("node", pa.int64()), ("root", pa.int64())]))
        found = [
            [{"node": n, "root": r} for n, r in spanning_links(np.array(a, np.int64), np.array(b, np.int64), max_bits)]
            for a, b in zip(xs.to_pylist(), ys.to_pylist(), strict=True)
        ]
        return pa.array(found, kind)

    return run(x, y)


def fingerprint_links(codes: DataFrame, code: str, max_bits: int, segments: int = 2, block: int = 512) -> DataFrame:
    """``(node, root)`` links that connect all distinct codes within ``max_bits`` bits.

    A segment value with more than ``block`` codes is cut in blocks by hash, and pairs of
    blocks are verified by tasks of their own: all its codes are compared, no task or row
    holds more than a few blocks, and no pairs are emitted but a spanning forest.
    """
    if BITS % segments or max_bits >= BITS:
        raise ValueError("segments must divide 64 and max_bits be below it")
    width = BITS // segments
    low = F.lit((1 << width) - 1) if width < BITS else F.lit(-1)
    parts = codes.select(
        F.col(code).alias("code"),
        F.posexplode(
            F.array(*[F.shiftrightunsigned(code, s * width).bitwiseAND(low) for s in range(segments)])
        ).alias("seg", "value"),
    )
    values = materialise(parts.groupBy("seg", "value").agg(F.count("*").alias("n")), "values")
    masks = F.array(*[F.lit(m).cast("bigint") for m in _masks(width, max_bits // segments)] or [F.lit(None).cast("bigint")])
    probes = (
        values.select("seg", F.col("value").alias("a"), F.col("n").alias("na"), F.explode(masks).alias("mask"))
        .select("seg", "a", "na", F.col("a").bitwiseXOR(F.col("mask")).alias("b"))
        .where("b > a")  # each pair of values is found from its lesser one
    )
    across = probes.join(
        values.select("seg", F.col("value").alias("b"), F.col("n").alias("nb")), ["seg", "b"]
    ).select("seg", "a", "b", "na", "nb")
    within = values.where("n > 1").select("seg", F.col("value").alias("a"), F.col("value").alias("b"), F.col("n").alias("na"), F.col("n").alias("nb"))
    pairs = materialise(across.union(within), "value-pairs")
    ends = pairs.select("seg", F.col("a").alias("value"), F.col("na").alias("n")).union(
        pairs.select("seg", F.col("b").alias("value"), F.col("nb").alias("n"))
    )
    blocks = (
        parts.join(ends.distinct(), ["seg", "value"])
        .withColumn("blk", F.expr(f"pmod(xxhash64(code), (n + {block - 1}) div {block})"))
        .groupBy("seg", "value", "blk")
        .agg(F.collect_list("code").alias("codes"))
    )
    blocks = materialise(blocks, "blocks")
    units = (
        pairs.select("seg", "a", "b", "nb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(na - 1) div {block}"))).alias("i"))
        .select("seg", "a", "b", "i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(nb - 1) div {block}"))).alias("j"))
        .where("a <> b OR i <= j")
    )
    left = blocks.select("seg", F.col("value").alias("a"), F.col("blk").alias("i"), F.col("codes").alias("xs"))
    right = blocks.select("seg", F.col("value").alias("b"), F.col("blk").alias("j"), F.col("codes").alias("ys"))
    return (
        units.join(left, ["seg", "a", "i"])
        .join(right, ["seg", "b", "j"])
        .select(F.explode(_verified(F.col("xs"), F.col("ys"), max_bits)).alias("link"))
        .select("link.node", "link.root")
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    max_bits: int = 3,
    seed: int = 42,
    segments: int = 2,
    carry: bool = False,
) -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the least id that links of at most ``max_bits`` bits reach, the
    document itself included. Texts without a word, null ones too, have fingerprint zero
    and link like any other. Repeated ids stay as rows; a null id stays null and never
    names a group unless all ids of the group are null. Other columns are ignored, unless
    ``carry`` adds each whole row as a struct ``row`` and ``group``, the fingerprint (hex) that
    roots the component, which tells apart components that share a least id (repeated ids).
    An empty table gives no rows.
    """
    kept = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    marked = materialise(
        docs.select(F.col(id_col).alias("id"), simhash(F.col(text_col), shingle, seed).alias("code"), *kept), "codes"
    )
    codes = marked.groupBy("code").agg(F.min("id").alias("first_id"))
    roots = components(fingerprint_links(codes, "code", max_bits, segments), "node", "root")
    rooted = codes.join(roots, codes["code"] == roots["node"], "left").select(
        "code", "first_id", F.coalesce("root", "code").alias("top")
    )
    least = rooted.groupBy("top").agg(F.min("first_id").alias("component_id"))
    # One row per distinct fingerprint; copies, however many, meet it in a join that AQE can split.
    labels = materialise(rooted.join(least, "top").select("code", "component_id", "top"), "labels")
    return marked.join(labels, "code").select(
        F.col("id").alias(id_col),
        F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"),
        "component_id",
        *([F.lpad(F.lower(F.hex("top")), 16, "0").alias("group"), "row"] if carry else []),
    )


def keep_representatives(groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, with the columns it had: ``groups`` from ``near_duplicates``
    with ``carry=True``.

    Of a group, the row with the least id stays, ties broken by fingerprint and a hash of the
    text; so two different texts under one id each keep their own group, and of exact repeats
    one row stays. Rows without an id cannot be named, so all of them stay. A partial
    aggregate per group, so a group of any size is reduced where it is read.
    """
    rank = F.struct(
        F.col(f"row.`{id_col}`").alias("id"),
        F.col("fingerprint"),
        F.xxhash64(F.col(f"row.`{text_col}`")).alias("text"),
    )
    fields = groups.schema["row"].dataType.fieldNames()
    named = F.col(f"row.`{id_col}`").isNotNull()
    best = groups.where(named).groupBy("group").agg(F.min_by("row", rank).alias("row"))
    rows = best.select("row").unionByName(groups.where(~named).select("row"))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in fields])
