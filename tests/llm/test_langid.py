import zlib

import numpy as np
import pytest

from quantloom.llm.langid import SYMBOLS, learn_profiles, ngrams, predict_lang, symbols
from quantloom.llm.queries import op3_language_id


def test_symbols_and_ngrams():
    assert symbols("Ab,  c1").tolist() == [0, 1, 2, 0, 3, 0]
    assert symbols("").tolist() == [0] and symbols("é")[1] >= 27 and symbols("𝒜x")[2] == 24
    grams, n = ngrams("aaaa", 3)
    assert dict(zip(grams.tolist(), n.tolist())) == {SYMBOLS + 1: 1, (SYMBOLS + 1) * SYMBOLS + 1: 2, (SYMBOLS + 1) * SYMBOLS: 1}


def test_vectors_against_a_plain_bundle(spark):
    df = spark.createDataFrame([("ab cab", "x"), ("zz zy", "y")], "text string, lang string")
    made = learn_profiles(df, dims=64)
    letters = made.letters()
    base = letters[2]
    for lang, text in (("x", "ab cab"), ("y", "zz zy")):
        at, want = symbols(text), np.zeros(64)
        for i in range(len(at) - 2):
            want += np.roll(base[at[i]], 2) * np.roll(base[at[i + 1]], 1) * base[at[i + 2]]
        cosine = made.prototypes[made.langs.index(lang)] @ want / np.linalg.norm(want)
        assert cosine == pytest.approx(1, abs=1e-4)


def test_held_out_accuracy_and_blind_to_other_columns(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in op3_language_id(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(rows) == len(docs)
    assert all(rows[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 5 == 0) for d in docs)
    held = [d for d in docs if rows[d.doc_id].held_out]
    assert np.mean([rows[d.doc_id].lang_pred == d.lang for d in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_nulls_no_letters_ties_long_and_empty(spark):
    df = spark.createDataFrame(
        [(1, "the cat and the dog", "en", 0.5), (2, "der hund und die katze", "de", 0.5), (3, None, "en", 0.5), (4, " 12 !", None, 0.5),
         (None, "der hund " * 200_000, None, 0.5), (6, "the cat", None, 0.5), (6, "the cat", None, 0.5)],
        "doc_id int, text string, lang string, score double",
    )
    made = learn_profiles(df)
    rows = df.select("score", predict_lang(df.text, made).alias("p")).collect()
    assert [r.p.lang_pred for r in rows] == ["en", "de", "und", "und", "de", "en", "en"] and rows[5] == rows[6]
    empty = df.limit(0)
    none = learn_profiles(empty)
    assert none.langs == [] and df.select(predict_lang(df.text, none).alias("p")).first().p.lang_pred == "und"
    assert empty.select(predict_lang(empty.text, made)).collect() == []
