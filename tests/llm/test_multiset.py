import hashlib
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quantloom.llm.multiset import add, as_hex, edited_fingerprints, likeness, subtract, with_fingerprint
from quantloom.llm.queries import op8_multiset_fingerprints


def units(text):
    for mark in ".!?":
        text = text.replace(mark + " ", mark + "\n")
    return [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]


def vector(text, words=32):
    out = [0] * (words + 1)
    for p in units(text):
        for i in range(words):
            h = xxhash.xxh64_intdigest(struct.pack("<i", i // 16), xxhash.xxh64_intdigest(p.encode(), 42))
            out[i] = (out[i] + (h >> i % 16 & 0x0001000100010001)) % (1 << 64)
        out[words] += 1
    return out


def shown(v):
    return "".join(f"{x:016x}" for x in v)


def alike(a, b):
    if a == b:
        return 1.0
    lanes = lambda v: np.array([w >> 16 * k & 0xFFFF for w in v[:-1] for k in range(4)], float)
    x, y = 2 * lanes(a) - a[-1], 2 * lanes(b) - b[-1]
    whole = (x * x).mean() + (y * y).mean()
    return min(1.0, max(0.0, 1 - ((x - y) ** 2).mean() / whole)) if whole else 0.0


def brute(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = {}
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = vector(t), vector(edited), vector(after)
        out[d] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), shown(a), shown(b), alike(a, b), alike(a, c))
    return out


def same(got, want):
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:5] == want[r.doc_id][:4]
        assert tuple(r)[5:] == pytest.approx(want[r.doc_id][4:], abs=2e-6)


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    got = op8_multiset_fingerprints(spark, folder).collect()
    same(got, brute([(d.doc_id, d.text) for d in docs]))
    assert np.mean([r.near_edited for r in got]) > 0.3 > 5 * np.mean([r.near_next for r in got])


def test_nulls_empty_long_and_single(spark):
    long = "A sentence 😀. " * 3 + "\n".join(f"line {i}" for i in range(30_000))
    rows = [(3, None), (None, "é x. y"), (7, long), (5, ""), (-2, "one\ntwo\n three"), (9, "b! c? d")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, vector int")
    same(edited_fingerprints(df).collect(), brute(rows))
    same(edited_fingerprints(df.where("doc_id = -2")).collect(), brute([rows[4]]))
    assert edited_fingerprints(df.limit(0)).collect() == []


def test_repeated_ids(spark):
    df = spark.createDataFrame([(2, "aaaa bbbb"), (1, "zz"), (1, "cc"), (2, "aaaa bbbb")], "doc_id int, text string")
    got = edited_fingerprints(df).collect()
    edited = hashlib.sha256(b"aaaa cc").hexdigest()
    assert [r.edited_sha256 for r in got if r.doc_id == 2] == [edited] * 2 and len(got) == 4


def test_order_independent_and_incremental(spark):
    df = spark.createDataFrame([("a\nb\nc", "c\na\nb", "a\nb", "c")], "w string, x string, y string, z string")
    for c in "wxyz":
        df = with_fingerprint(df, F.col(c), "f" + c)
    r = df.select(
        (F.col("fw") == F.col("fx")).alias("order"),
        (add(F.col("fy"), F.col("fz")) == F.col("fw")).alias("plus"),
        (subtract(F.col("fw"), F.col("fz")) == F.col("fy")).alias("minus"),
        as_hex(F.col("fw")).alias("hex"),
        likeness(F.col("fw"), F.col("fx")).alias("one"),
    ).first()
    assert r.order and r.plus and r.minus and r.one == 1 and r.hex == shown(vector("a\nb\nc"))


def lanes_of(text):
    """Lanes as they are, reduced by nothing, and the number of paragraphs."""
    lines, n = np.unique(units(text), return_counts=True)
    bits = []
    for seed in range(2):
        start = struct.pack("<i", seed)
        h = np.array([xxhash.xxh64_intdigest(start, xxhash.xxh64_intdigest(p.encode(), 42)) for p in lines.tolist()], np.uint64)
        bits += [int(n @ (h >> np.uint64(b) & np.uint64(1)).astype(np.int64)) for b in range(64)]
    return 2 * np.array(bits) - n.sum()


def test_200_000_lines(spark):
    many, same = "\n".join(f"line {i}" for i in range(200_000)), "the same\n" * 200_000
    df = spark.createDataFrame([(many, same, many[: len(many) // 2])], "x string, y string, z string").repartition(1)
    for c in "xyz":
        df = with_fingerprint(df, F.col(c), "f" + c)
    df = df.select(likeness(F.col("fx"), F.col("fz")), likeness(F.col("fy"), F.col("fx")), likeness(add(F.col("fx"), F.col("fy")), F.col("fy")))
    x, y, z = (lanes_of(t).astype(float) for t in (many, same, many[: len(many) // 2]))
    pairs = [(x, z), (y, x), (x + y, y)]
    want = [max(0, 1 - ((a - b) ** 2).mean() / ((a * a).mean() + (b * b).mean())) for a, b in pairs]
    assert list(df.first()) == pytest.approx(want, abs=2e-6)


def test_long_fingerprints_add_and_subtract(spark):
    df = spark.createDataFrame([("\n".join(f"x{i}" for i in range(70_000)), "\n".join(["y"] * 70_000))], "x string, y string")
    df = df.withColumn("both", F.concat_ws("\n", "y", "x"))
    for c in ("x", "y", "both"):
        df = with_fingerprint(df, F.col(c), "f" + c)
    plus, minus = add(F.col("fx"), F.col("fy")), subtract(F.col("fboth"), F.col("fy"))
    r = df.select((plus == F.col("fboth")).alias("plus"), (minus == F.col("fx")).alias("minus"), as_hex(F.col("fy")).alias("hex")).first()
    assert r.plus and r.minus and r.hex == shown(vector("\n".join(["y"] * 70_000)))
