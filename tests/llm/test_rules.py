import re
from collections import Counter

import numpy as np
import pytest

from quantloom.llm.queries import op5_quality_rules
from quantloom.llm.rules import References, Thresholds, js_distance, judge, references, repeat_words, verdict

FOLDER = "/root/testdata/sf0.001"


def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@pytest.fixture(scope="module")
def judged(spark):
    return {r.doc_id: r for r in op5_quality_rules(spark, FOLDER).collect()}


def test_base_columns_on_all_documents(spark, judged):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert len(docs) == len(judged)
    for d in docs:
        r, want = judged[d.doc_id], brute_base(d.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_distances_against_a_plain_version(spark, judged):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    refs = references(docs)
    rows = docs.collect()
    for lang in refs.langs:
        mine = [r.text for r in rows if r.lang == lang and len(r.text.encode().split()) >= 50]
        words = Counter(w.lower().strip(b".,;:!?\"'()[]#*$%&|<>") for t in mine for w in t.encode().split())
        total = sum(words.values())
        want = {w: n / total for w, n in words.items() if n >= 0.004 * total}
        assert refs.words[refs.langs.index(lang)] == pytest.approx(want)
        upper = np.mean([sum("A" <= c <= "Z" for c in t) / len(t) for t in mine])
        assert refs.chars[refs.langs.index(lang)][1] == pytest.approx(upper, abs=1e-5)
    for r in rows[:50]:
        assert judge(r.text.encode(), refs, Thresholds())[6:8] == pytest.approx((judged[r.doc_id].char_distance, judged[r.doc_id].word_distance))


def test_junk_goes_and_clean_stays(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = {0: [], 1: []}
    for r in op5_quality_rules(spark, folder).collect():
        if r.doc_id in labels and r.n_words >= 50:
            kept[labels[r.doc_id]].append(r.kept)
    assert np.mean(kept[1]) == 1 and np.mean(kept[0]) < 0.05


def test_jensen_shannon():
    p, q = np.array([0.5, 0.5, 0]), np.array([0, 0.5, 0.5])
    assert js_distance(p, p) == 0 and js_distance(np.array([1.0, 0]), np.array([0, 1.0])) == 1
    assert js_distance(p, q) == pytest.approx(np.sqrt(0.5))


def test_repeats():
    for text in ("", "a b", "a b c", "a b c a b c", "x x x x", "p a b c q a b c r"):
        assert repeat_words(text.encode().split()) == brute_base(text)[4]


def test_nulls_long_texts_and_no_references(spark):
    long = "word " * 400_000 + "😀é\x0b\n"
    df = spark.createDataFrame([(None, None, "en", 1), (1, "", None, 1), (2, long, None, 1), (2, long, None, 1)], "doc_id int, text string, lang string, kept int")
    rows = df.select("kept", verdict(df.text, references(df)).alias("q")).collect()
    assert [r.q.n_words for r in rows] == [0, 0, 400_001, 400_001] and all(r.q.base_failed and not r.q.kept for r in rows)
    assert rows[2].q.word_chars == 1_600_002 and rows[0].kept == 1
    empty = df.limit(0)
    assert references(empty).langs == [] and empty.select(verdict(empty.text, References())).collect() == []
