import re

import pytest
import xxhash
from pyspark.sql import functions as F

from quantloom.llm.simhash import keep_representatives, near_duplicates

SCHEMA = "doc_id bigint, text string, component_id string, code string, n int"


def brute_print(text, shingle=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    grams = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [brute_print(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {g: min((d for (d, _), h in zip(rows, group) if h == g and d is not None), default=None) for g in group}
    return sorted(((d, f"{p:016x}", least[g]) for (d, _), p, g in zip(rows, prints, group)), key=str)


def made(spark, rows):
    df = spark.createDataFrame([(d, t, "x", "y", 1) for d, t in rows], SCHEMA)
    return near_duplicates(df)


def test_equals_all_pairs_on_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in near_duplicates(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()), key=str)
    assert got == brute(rows)
    assert len({r[2] for r in got}) < len(got)


def test_dense_group_of_near_copies_chains_and_blocks(spark, monkeypatch):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(1000 + i, base + f" tail{i}") for i in range(150)] + [(i, base) for i in range(1, 6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    from quantloom.llm import simhash as module

    codes = spark.createDataFrame([(brute_print(t) - (1 << 64) if brute_print(t) >> 63 else brute_print(t),) for _, t in rows], "code bigint").distinct()
    links = module.fingerprint_links(codes, "code", 3, 2, block=8)
    assert links.count() < 40 * codes.count()
    assert sorted((tuple(r) for r in near_duplicates(df).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("segments", [1, 2, 4])
def test_any_number_of_segments(spark, segments):
    values = [0, 1, 3, 7, 15, 1 << 40, (1 << 40) | 3, -1, -2, 1 << 62]
    codes = spark.createDataFrame([(v,) for v in values], "code bigint")
    from quantloom.llm.components import components
    from quantloom.llm.simhash import fingerprint_links

    if segments == 1:
        links = fingerprint_links(codes, "code", 2, 1)
        want = 2
    else:
        links = fingerprint_links(codes, "code", 2, segments)
        want = 2
    roots = dict(tuple(r) for r in components(links, "node", "root").collect())
    groups = {}
    for v in values:
        groups.setdefault(roots.get(v, v), set()).add(v)
    brute_groups = [{v} for v in values]
    for a in values:
        for b in values:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= want:
                ga, gb = next(g for g in brute_groups if a in g), next(g for g in brute_groups if b in g)
                if ga is not gb:
                    ga |= gb
                    brute_groups.remove(gb)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, brute_groups))


def test_nulls_empty_ties_and_long_texts(spark):
    long = " ".join(f"word{i % 977}x{i % 13}" for i in range(150_000))
    rows = [(7, None), (3, ""), (None, "  \n"), (9, "One two"), (9, "one TWO"), (None, "a b c d"), (5, "ÄRGER x"), (6, "ärger x"), (11, long), (12, long)]
    got = sorted((tuple(r) for r in made(spark, rows).collect()), key=str)
    assert got == brute(rows)
    assert made(spark, []).collect() == []
    assert [f.dataType.simpleString() for f in made(spark, rows).schema] == ["bigint", "string", "bigint"]


def test_one_of_each_group_stays_and_columns_too(spark):
    df = spark.createDataFrame(
        [(2, "a b c", "x"), (1, "a b c", "y"), (1, "a b c", "z"), (None, "a b c", "q"), (4, "other words here now", "p")],
        "doc_id bigint, text string, component_id string",
    )
    left = keep_representatives(near_duplicates(df, carry=True))
    assert left.columns == df.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "4", "None"]
    assert near_duplicates(df.withColumn("fingerprint", F.lit(1))).count() == 5


def test_one_id_with_two_texts_keeps_both_groups(spark):
    copy = "the same words in a row for a copy"
    df = spark.createDataFrame(
        [(3, copy, "a"), (5, copy, "b"), (5, "quite other words that stand alone", "c"), (5, "a third text of its own kind", "d"), (5, "a third text of its own kind", "d")],
        "doc_id bigint, text string, row string",
    )
    left = keep_representatives(near_duplicates(df, carry=True))
    assert left.columns == df.columns
    assert sorted(r.row for r in left.collect()) == ["a", "c", "d"]
