import zlib
from functools import partial

import numpy as np
import public_tokenizers as public
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quantloom.llm.common import chunked_tokenizer, spaced_words, words
from quantloom.llm.packing import OpenBins, pack_documents
from quantloom.llm.queries import op4_best_fit_packing

TEXTS = ["", " ", "The the, DOG's 12 cats\n\n x", "é ﬁ Ⅳ 中文 😀", "a\xa0 b \n c\t", "odd\x1cspace !\x1c x", "<|endoftext|> x <|startoftext|>", "x" * 300 + "  y", "Word, word. Wörd's ÉTÉ! a..b x.,y\nNext: ok?"]


def library(name):
    made = Tokenizer.from_file(public.path(name))
    made.encode_special_tokens = True
    return made


@pytest.mark.parametrize("name,cut,lower", [("word_bpe_49k.json", words, True), ("byte_bpe_50k.json", spaced_words, False)])
def test_chunks_encode_like_the_whole(name, cut, lower):
    chunked, whole = chunked_tokenizer(public.path(name), cut, lower), library(name)

    @settings(max_examples=120, deadline=None)
    @given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t\r aeÉŸ'st.,1Σİ\u0301\u0331")), max_size=40), max_size=4))
    def same(texts):
        assert [x.tolist() for x in chunked(texts)] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]

    same()
    assert [x.tolist() for x in chunked(TEXTS)] == [e.ids for e in whole.encode_batch(TEXTS, add_special_tokens=False)]
    chunked.size = 2  # a cache that starts afresh all the time gives the same
    assert [x.tolist() for x in chunked(TEXTS)] == [e.ids for e in whole.encode_batch(TEXTS, add_special_tokens=False)]


def brute_best_fit(items, size, limit):
    """Open bins as a plain list of [number, free]."""
    bins, made, out = [], 0, []
    for x in items:
        fit = [b for b in bins if b[1] >= x]
        if fit:
            b = min(fit, key=lambda b: b[1])
        else:
            if len(bins) >= limit:
                bins.remove(min(bins, key=lambda b: b[1]))
            b = [made, size]
            made += 1
            bins.append(b)
        out.append((b[1], x))
        b[1] -= x
        bins = [b for b in bins if b[1]]
    return out, made


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60), st.integers(1, 6))
def test_bins_against_a_plain_list(items, limit):
    bins = OpenBins(20, limit)
    placed = [bins.place(x) for x in items]
    want, made = brute_best_fit(items, 20, limit)
    assert bins.made == made and [20 - p[1] for p in placed] == [w[0] for w in want]


def check(rows, size):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert [a for a, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1].tolist()]
        assert sum(n for _, n in parts) <= size
    return len(by)


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = op4_best_fit_packing(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    whole, want = library("word_bpe_49k.json"), set()
    for d in docs:
        ids = np.array([*whole.encode(d.text or "", add_special_tokens=False).ids, 1], "<u4")
        want |= {(d.doc_id, k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    used, tokens = check(rows, 4096), sum(r.length for r in rows)
    assert used <= -(-tokens // 4096) + 2


def test_nulls_repeats_long_texts_and_empty(spark):
    df = spark.createDataFrame([(None, None, 1), (1, "", 1), (2, "word " * 30_000, 1), (2, "word " * 30_000, 1)], "doc_id int, text string, piece int")
    tokenizer = partial(chunked_tokenizer, public.path("word_bpe_49k.json"), words, lower=True)
    rows = pack_documents(df, tokenizer, 1).collect()
    assert sorted((str(r.doc_id), r.piece) for r in rows) == sorted([("None", 0), ("1", 0), *[("2", k) for k in range(8)] * 2])
    check(rows, 4096)
    assert all(r.length == 4096 for r in rows if r.doc_id == 2 and r.piece < 7)
    assert pack_documents(df.limit(0), tokenizer, 1).collect() == []


QUOTES = [*TEXTS, "a <|endoftext|> b", "<|endoftext|><|startoftext|>x\n\n<|endoftext|> ", "A <|ENDOFTEXT|> b <|endoftext|", "\x1c a <|endoftext|>b", "\0 <|endoftext|> Of"]


@pytest.mark.parametrize("name,cut,lower", [("word_bpe_49k.json", words, True), ("byte_bpe_50k.json", spaced_words, False)])
def test_special_tokens_in_texts_as_by_the_plain_library(name, cut, lower):
    plain = Tokenizer.from_file(public.path(name))
    got = [x.tolist() for x in chunked_tokenizer(public.path(name), cut, lower, special=True)(QUOTES)]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in QUOTES]


def test_queries_take_quoted_special_tokens_as_tokens(spark, tmp_path):
    from quantloom.llm.queries import op6_binary_records

    rows = [(k, t) for k, t in enumerate(QUOTES)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for query, name, end in ((op4_best_fit_packing, "word_bpe_49k.json", 1), (op6_binary_records, "byte_bpe_50k.json", 2)):
        plain = Tokenizer.from_file(public.path(name))
        want = {k: zlib.crc32(np.array([*plain.encode(t, add_special_tokens=False).ids, end], "<u4").tobytes()) for k, t in rows}
        assert {r.doc_id: r.ids_crc32 for r in query(spark, str(tmp_path)).collect()} == want
