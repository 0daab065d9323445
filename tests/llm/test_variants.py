import os

import pytest

from quantloom.llm import hot, variants
from quantloom.llm.variants import variant_groups
from tests.llm.variants_brute import brute_variants

COLS = ["word", "form", "root", "n", "n_near", "form_n"]


def _run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, word string, n long")
    return sorted((tuple(r) for r in variant_groups(df).select(*COLS).collect()), key=repr)


def _fixture():
    rows = []
    for i in range(60):
        rows.append((i, "Receive receive RECEIVING réception réceptions"))
    for i in range(60, 64):
        rows.append((i, "recieve recieve recieves receve receivee récéption"))
    rows += [(None, "recieve recieve"), (70, None), (71, ""), (72, "x" * 50_000), (73, "abcdefg abcdefg abcdefh abcdefh")]
    rows += [(74, "abcdefg abcdefg")] * 3  # repeated rows
    return rows


def test_fixture_against_brute_force(spark):
    rows = _fixture()
    assert _run(spark, rows) == brute_variants(rows)


def test_tiny_filter_keeps_results_exact(spark, monkeypatch):
    monkeypatch.setattr(variants, "MAX_FILTER_BYTES", 64)  # nearly every probe a false positive
    monkeypatch.setattr(hot, "HOT_ROWS", 2)
    rows = _fixture()
    assert _run(spark, rows) == brute_variants(rows)


def test_empty_table(spark):
    assert _run(spark, []) == []


def test_whole_table_against_brute_force(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test table")
    df = spark.read.parquet(path)
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in variant_groups(df).select(*COLS).collect()), key=repr)
    assert got == brute_variants(rows)
