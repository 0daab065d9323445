import zlib

import numpy as np
import pytest

from quantloom.llm import quality as Q
from quantloom.llm import toxicity as T
from quantloom.llm.learning import SparseRows, hashed_sample
from quantloom.llm.queries import op9_toxicity, op10_quality_classifier

FOLDER = "/root/testdata/sf0.1"


def auc(score, y):
    rank = np.argsort(np.argsort(score))
    return (rank[y == 1].mean() - (np.sum(y == 1) - 1) / 2) / np.sum(y == 0)


def held_out(spark, query, label, folds, fold):
    rows = {r.doc_id: r for r in query(spark, FOLDER).collect()}
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    ids = [d for d in rows if d in labels]
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % folds == fold) for d, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    held = [d for d in ids if rows[d].held_out]
    return np.array([rows[d].score for d in held]), np.array([labels[d] for d in held])


def test_toxicity_on_held_out_rows(spark):
    score, y = held_out(spark, op9_toxicity, "toxic", 4, 2)
    assert auc(score, y) > 0.9 and np.mean((score >= 0.3) == (y == 1)) > 0.9


def test_quality_on_held_out_rows(spark):
    score, y = held_out(spark, op10_quality_classifier, "quality", 5, 0)
    assert auc(score, y) > 0.97 and np.mean((score >= 0.3) == (y == 1)) > 0.9


def test_nnpu_finds_hidden_positives():
    rng = np.random.default_rng(0)
    s = T.Settings(bits=8)
    text = lambda toxic: np.unique(np.concatenate((rng.integers(10, 200, 12), [3] if toxic else [4])))
    hidden = rng.random(2000) < 0.2
    rows = [text(h) for h in hidden]
    ones = lambda r: [np.ones(len(x)) for x in r]
    known = [text(True) for _ in range(200)]
    model = T.fit_nnpu(SparseRows(known, ones(known)), SparseRows(rows, ones(rows)), 0.2, s)
    score = np.array([model.score(r) for r in rows])
    assert auc(score, hidden.astype(int)) > 0.99 and np.mean((score > 0.5) == hidden) > 0.97


def test_gradient_of_the_embeddings_lowers_the_loss():
    rows = SparseRows([np.array([1, 2]), np.array([2, 3]), np.zeros(0, int)], [np.ones(2), np.ones(2), np.zeros(0)])
    model = Q.fit_embeddings(rows, np.array([1, 0, 1]), Q.Settings(bits=3, dims=4, epochs=300, batch=2))
    gain = lambda at: model.bias + np.mean(model.per_feature[at])
    assert gain([1, 2]) > 0 > gain([2, 3])


def test_repeated_neighbours_share_a_feature():
    words = Q.Subwords(16, (3,))
    at, n = words("ab ab ab xyz xyz")
    assert n[at == 0][0] >= 3
    assert set(words("")[0]) == set() and len(words("a")[0]) > 0


@pytest.mark.parametrize("label", ["toxic", "quality"])
def test_nulls_empty_long_repeats_and_no_labels(spark, label):
    long = "word " * 200_000
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, long, 5), (3, long, 5), (None, "bad thing", 5), (4, "bad thing", 5)], "doc_id int, text string, score int")
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 1), (None, 1), (9, None)], f"doc_id int, {label} int")
    learn, use = (T.learn_toxicity, T.toxicity) if label == "toxic" else (Q.learn_quality, Q.quality)
    model = learn(docs, labels)
    rows = docs.select("score", use(docs.text, model).alias("s")).collect()
    assert all(0 <= r.s <= 1 for r in rows) and rows[0].s == rows[1].s and rows[2] == rows[3] and rows[4] == rows[5]
    none = learn(docs, labels.limit(0))
    assert all(0 <= r.s <= 1 for r in docs.select(use(docs.text, none).alias("s")).collect())
    assert docs.limit(0).select(use(docs.text, model)).collect() == []


def test_sample_is_bounded_and_stable(spark):
    df = spark.range(5000).toDF("id")
    a = {r.id for r in hashed_sample(df, "id", 500).collect()}
    assert 350 < len(a) < 650 and a == {r.id for r in hashed_sample(df.repartition(7), "id", 500).collect()}
    assert hashed_sample(df.limit(20), "id", 500).count() == 20 and hashed_sample(df.limit(0), "id", 5).count() == 0


def test_word_table_scores_like_one_text_at_a_time():
    rng = np.random.default_rng(4)
    model = Q.Model(rng.normal(size=1 << 10).astype(np.float32), 0.3, 10, (3, 4))
    vocab = [bytes(rng.choice(list(b"abcdefgh"), rng.integers(1, 9))) for _ in range(300)]
    texts = [[vocab[i] for i in rng.integers(0, 300, rng.integers(0, 40))] for _ in range(200)]
    texts += [[], [b"same"] * 50, [b"x" * 5000]]
    words = Q.Subwords(10, (3, 4))
    gain = model.per_feature.astype(np.float64)

    def plain(text):
        feats = [f for w in text for f in words.of_word(w)]
        heads = np.array([words.of_word(w)[0] for w in text], np.int64)
        pairs = words.of_pairs(heads) if len(text) > 1 else np.zeros(0, np.int64)
        z = model.bias + (gain[feats].sum() + gain[pairs].sum()) / max(1, len(feats) + len(pairs))
        return round(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))), 6)

    table = Q._WordTable(model, size=64)  # small: the newer half goes again and again
    got = []
    for start in range(0, len(texts), 17):
        got += Q.score_texts(table, model.bias, texts[start : start + 17])
    assert len(table.index) <= 64 + 17 * 40
    assert got == pytest.approx([plain(t) for t in texts], abs=2e-6)


@pytest.mark.parametrize("clean", [2_000, 12_000])
def test_rare_toxic_word_found_at_any_corpus_size(spark, clean):
    """A word of 24 confirmed toxic texts marks the hidden toxic texts, however large the corpus."""
    rng = np.random.default_rng(7)
    common = ["".join("abcdefghij"[int(c)] for c in f"{i:03d}") for i in range(500)]

    def text(toxic):
        return " ".join(rng.choice(common, 12).tolist() + (["zorblax"] if toxic else []))

    rows = [(i, text(i < 24 + 40)) for i in range(clean + 64)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(24)] + [(i, 0) for i in range(100, 400)], "doc_id long, toxic int")
    model = T.learn_toxicity(docs, labels, settings=T.Settings(bits=14))
    scored = {r.doc_id: r.s for r in docs.select("doc_id", T.toxicity(docs.text, model).alias("s")).collect()}
    hidden = [scored[i] for i in range(24, 64)]
    assert np.mean(np.array(hidden) >= 0.3) >= 0.9
    assert np.mean(np.array([scored[i] for i in range(64, clean + 64)]) < 0.3) >= 0.9


def test_quality_labels_by_majority_and_long_rows_kept(spark, monkeypatch):
    """Conflicting labels of one id take the most frequent (ties: the lesser); a row over the feature bound is sampled, not dropped."""
    seen = {}
    real = Q.fit_embeddings
    monkeypatch.setattr(Q, "fit_embeddings", lambda rows, y, s: seen.update(rows=rows, y=y) or real(rows, y, s))
    long = " ".join(f"w{i}x" for i in range(20_000))
    docs = spark.createDataFrame([(1, "good text"), (2, "bad text"), (3, long), (3, "other")], "doc_id int, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (1, 1), (2, 1), (2, 0), (3, 1)], "doc_id int, quality int")
    Q.learn_quality(docs, labels, settings=Q.Settings(max_features=500))
    assert sorted(seen["y"].tolist()) == [0, 1, 1] and len(seen["rows"]) == 3
    assert max(seen["rows"].size) <= 700


def test_sampling_a_long_row_is_linear_in_its_features(spark, monkeypatch):
    """Nothing that grows with the row is made anew inside the lambda that is run for each of its features."""
    plans = []
    real = Q.collect_rows
    monkeypatch.setattr(Q, "collect_rows", lambda df, extra: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, extra))
    docs = spark.createDataFrame([(1, "good text"), (2, "bad text")], "doc_id int, text string")
    Q.learn_quality(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id int, quality int"))
    inside = plans[0].split("lambdafunction(")[1:]
    assert inside and not any("arrays_zip" in part.split(", lambda ")[0] for part in inside)
