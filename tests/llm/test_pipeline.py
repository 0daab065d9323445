import numpy as np
from tokenizers import Tokenizer
import public_tokenizers as public

import corpus_pipeline
from quantloom.llm.langid import learn_profiles, predict_lang
from quantloom.llm.rules import Thresholds, judge, references
from tests.llm.test_simhash import brute

FOLDER = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = docs.collect()
    refs = references(docs)
    good = [r for r in rows if judge((r.text or "").encode(), refs, Thresholds())[-1]]
    first = corpus_pipeline.quality_rules(spark, docs, FOLDER)
    assert first.columns == docs.columns and sorted(first.collect()) == sorted(good)
    second = corpus_pipeline.language_id(spark, first, FOLDER)
    scored = first.select("doc_id", predict_lang(first.text, learn_profiles(first)).alias("p")).collect()
    named = {r.doc_id for r in scored if r.p.lang_pred != "und" and r.p.score >= 0.4}
    assert second.columns == docs.columns and {r.doc_id for r in second.collect()} == named
    third = corpus_pipeline.near_dedup(spark, second, FOLDER)
    kept = {d for d, _, group in brute([(r.doc_id, r.text) for r in second.collect()]) if d == group}
    assert third.columns == docs.columns and {r.doc_id for r in third.collect()} == kept
    assert len(third.collect()) == len(kept) < len(rows)
    texts = {r.doc_id: r.text for r in third.collect()}
    out = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id for r in out} == kept
    library = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    sizes = {d: len(library.encode(t, add_special_tokens=False).ids) + 1 for d, t in texts.items()}
    assert {d: sum(r.length for r in out if r.doc_id == d) for d in kept} == sizes
    assert all(0 <= r.offset and r.offset + r.length <= 4096 for r in out)
    assert len({r.sequence_id for r in out}) <= -(-sum(sizes.values()) // 4096) + 2


def test_edge_rows_pass_through_all_stages(spark):
    text = " ".join(f"the word{i % 37} and of" for i in range(60))
    df = spark.createDataFrame(
        [(None, None, None, None, None, 1), (1, "", "en", "s", 0, 1), (2, text, "en", "s", 9, 1), (2, text, "en", "s", 9, 1), (3, text * 500, None, None, 9, 1)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint, component_id int",
    )
    for table in (df, df.limit(0)):
        now = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, FOLDER)
            assert now.columns == df.columns
        assert np.all([r.length > 0 for r in corpus_pipeline.STAGES[-1][1](spark, now, FOLDER).collect()])


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "near_dedup", "best_fit_packing"]


def test_without_any_language_texts_with_letters_stay(spark):
    rows = [(1, "the words", None), (2, "12 ... 34", None), (3, None, None), (None, "é", None), (5, "中", None), (6, "", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    kept = corpus_pipeline.language_id(spark, df, FOLDER)
    assert kept.columns == df.columns and {r.text for r in kept.collect()} == {"the words", "é", "中"}
