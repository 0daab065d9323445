import os

import pytest

from quantloom.llm.trie import prefix_nodes, rebuilt
from tests.llm.trie_brute import brute_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, key string"
COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _run(spark, rows, band=8):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)  # an extra column named like an inner one
    got = prefix_nodes(rebuilt(df), band=band).select(*COLS).collect()
    return sorted((tuple(r) for r in got), key=repr)


FIXTURE = [
    (0, 1, "user", "hello there friend"),
    (0, 2, "assistant", "hi"),
    (0, 3, "user", "bye now"),
    (1, 0, "user", "hello there friend"),
    (1, 1, "assistant", "other"),
    (3, None, None, None),  # null turn first, null role and text empty
    (3, 2, "user", "a b c"),
    (3, 2, "user", "a b c"),  # repeated row: two equal turns
    (5, 7, "assistant", "x"),
    (5, 7, "user", "x"),  # tie on turn: role decides
    (20, 1, "user", "w " * 5000),  # long text
    (21, 1, "user", "q"),
    (22, 1, "user", "q"),
    (None, 1, "user", "no conversation"),
    (40, 1, "user", ""),
]


@pytest.mark.parametrize("band", [1, 2, 3, 8])
def test_fixture_against_brute_force(spark, band):
    assert _run(spark, FIXTURE, band) == brute_trie(FIXTURE)


def test_deep_chain_crosses_bands(spark):
    rows = [(c, t, "user" if t % 2 else "assistant", f"t{t} " * (t % 3)) for c in (60, 61, 62) for t in range(c - 40)]
    assert _run(spark, rows, 3) == brute_trie(rows)


def test_empty_table(spark):
    assert _run(spark, []) == []


def test_whole_table_against_brute_force(spark):
    path = "/root/testdata/sf0.01/conversations.parquet"
    if not os.path.exists(path):
        pytest.skip("no test table")
    df = spark.read.parquet(path)
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in prefix_nodes(rebuilt(df)).select(*COLS).collect()), key=repr)
    assert got == brute_trie(rows)
