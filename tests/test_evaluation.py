import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom import Roles
from quantloom.functions.stats import student_p
from quantloom.operators import comparison as cmp
from quantloom.operators import scoring as sc
from quantloom.operators import splits as sp
from quantloom.operators import utility as ut
from quantloom.operators.quantiles import exact_quantiles

R = Roles()


def groups_frame(spark, days):
    return spark.createDataFrame([(d, i) for d in days for i in range(2)], "date int, row_id int")


def by_fold(df):
    out = {}
    for row in df.collect():
        out.setdefault((row["fold"], row["role"]), set()).add(row["date"])
    return out


def brute_purged(days, n, max_train, gap):
    chunks = np.array_split(sorted(set(days)), n + 1)
    out, fold = {}, 0
    for i in range(n):
        train = [g for c in chunks[: i + 1] for g in c]
        test = list(chunks[i + 1])
        if max_train and len(train) > max_train:
            train = train[-max_train:]
        if gap > 0:
            train = [g for g in train if g < min(test) - gap]
        if train and test:
            out[fold, "train"], out[fold, "test"] = set(train), set(test)
            fold += 1
    return out


@pytest.mark.parametrize("n,max_train,gap", [(5, None, 0), (5, None, 3), (3, 4, 1), (5, 2, 30), (22, None, 0)])
def test_purged_splits(spark, n, max_train, gap):
    days = [d * 2 + (d > 9) * 5 for d in range(23)]
    got = by_fold(sp.purged_splits(groups_frame(spark, days), "date", n, max_train, gap))
    assert got == brute_purged(days, n, max_train, gap)


def test_purged_splits_need_enough_groups(spark):
    with pytest.raises(ValueError, match="Not enough groups"):
        sp.purged_folds(groups_frame(spark, range(5)), "date", 5)
    with pytest.raises(ValueError, match="not found"):
        sp.purged_folds(groups_frame(spark, range(9)), "day", 5)


def test_unknown_strategy(spark):
    with pytest.raises(ValueError, match="Unknown CV strategy"):
        sp.make_folds(groups_frame(spark, range(9)), R, "random")


def test_time_series_folds(spark):
    df = spark.range(23).withColumnRenamed("id", "row_id")
    got = sp.assign(df, sp.time_series_folds(df, "row_id", 4)).toPandas()
    for i, first in enumerate([7, 11, 15, 19]):
        part = got[got["fold"] == i]
        assert sorted(part[part["role"] == "train"]["row_id"]) == list(range(first))
        assert sorted(part[part["role"] == "test"]["row_id"]) == list(range(first, first + 4))


@pytest.mark.parametrize("exact", [True, False])
def test_stratified_folds_hold_every_class(spark, exact):
    df = spark.range(1003).select(F.col("id").alias("row_id"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    made = sp.with_stratified_fold(df, "y", 4, 7, exact=exact)
    counts = made.groupBy("y", "fold").count().toPandas().pivot(index="y", columns="fold", values="count")
    assert made.count() == 1003 and counts.shape == (2, 4)
    if exact:
        assert (counts.max(axis=1) - counts.min(axis=1) <= 1).all()


def test_holdout_share(spark):
    df = spark.range(1000).select(F.col("id").alias("row_id"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    held = sp.holdout(df, "y", 0.2, 1).where("is_validation").groupBy("y").count()
    assert {r["y"]: r["count"] for r in held.collect()} == {0: 150, 1: 50}


def trades(spark, rows):
    return spark.createDataFrame(rows, "date int, pred double, weight double, resp double")


def test_utility_reads_scores_and_decisions(spark):
    df = trades(spark, [(0, 0.7, 2.0, 0.1), (0, 0.2, 1.0, 5.0), (1, 1.0, 1.0, 0.3), (1, 3.0, 1.0, 0.1), (1, 0.0, 9.0, 9.0)])
    got = {r["date"]: r["utility"] for r in ut.utility(df, "pred", R, ["date"]).collect()}
    assert math.isclose(got[0], 0.2) and math.isclose(got[1], 0.6)
    acts = {(r["date"], r["pred"]): r["action"] for r in ut.actions(df, "pred", ["date"]).collect()}
    assert acts == {(0, 0.7): 1, (0, 0.2): 0, (1, 1.0): 1, (1, 3.0): 3, (1, 0.0): 0}
    assert math.isclose(ut.utility(df, "pred", R, ["date"], penalty=0.5).where("date = 0").first()[1], -0.3)


def test_missing_inputs_of_utility(spark):
    df = trades(spark, [(0, 0.7, None, 0.1), (0, 0.8, 1.0, 2.0), (0, None, 1.0, 3.0)])
    assert ut.utility(df, "pred", R).first()[0] == 2.0
    assert ut.utility(df, "pred", R, propagate_missing=True).first()[0] is None


def test_improvement_over_zero_and_negative(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.0, -1.0), (-2.0, 1.0), (2.0, 3.0)], "b double, m double")
    got = [r[0] for r in df.select(ut.improvement(F.col("b"), F.col("m"))).collect()]
    assert got == [100.0, 0.0, 150.0, 50.0]


def test_no_trades(spark):
    row = ut.trading_performance(trades(spark, [(0, 0.1, 1.0, 0.5)]), "pred", R).first()
    assert row["n_trades"] == 0 and row["avg_return_per_trade"] == 0 and row["hit_rate"] == 0


def test_deciles_match_qcut(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"pred": rng.random(503), "weight": rng.random(503), "resp": rng.normal(size=503), "date": 0})
    got = ut.decision_deciles(spark.createDataFrame(pdf), "pred", R).orderBy("pred_quantile").toPandas()
    pdf["q"] = pd.qcut(pdf["pred"], 10, labels=False)
    want = pdf.groupby("q")
    assert list(got["prediction_count"]) == list(want.size())
    np.testing.assert_allclose(got["prediction_mean"], want["pred"].mean(), atol=5.1e-5)
    gain = (pdf["resp"] * pdf["weight"] * (pdf["pred"] >= 0.5)).groupby(pdf["q"]).sum()
    np.testing.assert_allclose(got["utility"], gain, atol=1e-9)


def test_duplicate_decile_edges(spark):
    with pytest.raises(ValueError, match="unique"):
        ut.decision_deciles(trades(spark, [(0, 0.5, 1.0, 1.0)] * 20), "pred", R)


@pytest.mark.parametrize("group_rows", [1_000_000, 40])
def test_exact_quantiles(spark, group_rows):
    rng = np.random.default_rng(5)
    a = rng.normal(size=3000)
    a[::3] = 0.25  # a third of the rows share one value
    b = rng.integers(0, 500, 1000).astype(float)
    pdf = pd.DataFrame({"g": ["a"] * 3000 + ["b"] * 1000 + ["c"], "v": np.concatenate([a, b, [7.0]])})
    qs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = exact_quantiles(spark.createDataFrame(pdf), "v", qs, ["g"], group_rows).toPandas()
    for g, part in pdf.groupby("g"):
        mine = got[got["g"] == g].sort_values("q")["value"]
        np.testing.assert_allclose(mine, np.quantile(part["v"], qs), atol=1e-12)
    whole = exact_quantiles(spark.createDataFrame(pdf), "v", [0.5], (), group_rows).first()["value"]
    assert math.isclose(whole, pdf["v"].median())


def brute_auc(pred, y):
    pos, neg = pred[y == 1], pred[y == 0]
    return np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))


def test_auc_with_ties_and_single_class(spark):
    rng = np.random.default_rng(11)
    pred = np.where(rng.random(600) < 0.35, 0.5, rng.random(600).round(2))
    y = rng.integers(0, 2, 600)
    fold = rng.integers(0, 3, 600)
    y[fold == 2] = 1
    df = spark.createDataFrame(pd.DataFrame({"pred": pred, "y": y, "fold": fold}))
    got = {r["fold"]: r["auc"] for r in sc.auc(df, "pred", "y", ["fold"]).collect()}
    for f in (0, 1):
        assert math.isclose(got[f], brute_auc(pred[fold == f], y[fold == f]))
    assert got[2] == 0.5


def test_undefined_precision_and_recall_are_zero(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 0)], "pred double, y int")
    row = sc.classification_metrics(df, "pred", "y").first()
    assert (row["auc"], row["accuracy"], row["precision"], row["recall"]) == (0.5, 1.0, 0.0, 0.0)


def test_threshold_is_inclusive_or_not(spark):
    df = spark.createDataFrame([(0.5,)], "p double")
    assert df.select(sc.predicted(F.col("p"))).first()[0] == 1
    assert df.select(sc.predicted(F.col("p"), inclusive=False)).first()[0] == 0


def test_student_p_at_tabled_critical_values(spark):
    # Two-sided 5 % points of Student's t.
    table = [(1, 12.7062), (2, 4.30265), (3, 3.18245), (4, 2.77645), (5, 2.57058), (10, 2.22814), (11, 2.20099), (30, 2.04227)]
    df = spark.createDataFrame(table, "v long, t double")
    for row in df.select(student_p(F.col("t"), F.col("v")).alias("p")).collect():
        assert abs(row["p"] - 0.05) < 1e-5
    one = spark.createDataFrame([(0.0, 4), (float("inf"), 4), (-2.77645, 4)], "t double, v long")
    got = [r[0] for r in one.select(student_p(F.col("t"), F.col("v"))).collect()]
    assert got[0] == 1.0 and got[1] == 0.0 and abs(got[2] - 0.05) < 1e-5


def scores(spark, a, b, metric="utility"):
    rows = [("a", i, metric, v) for i, v in enumerate(a)] + [("b", i, metric, v) for i, v in enumerate(b)]
    return spark.createDataFrame(rows, "model string, fold int, metric string, score double")


def test_paired_ttest_and_its_order(spark):
    s = scores(spark, [1.0, 2.0, 3.0, 4.0, 5.0], [1.5, 2.7, 3.1, 4.9, 5.3])
    one, two = cmp.paired_ttest(s, "a", "b").first(), cmp.compare(s, "a", "b").first()
    d = np.array([-0.5, -0.7, -0.1, -0.9, -0.3])
    t = d.mean() / (d.std(ddof=1) / np.sqrt(5))
    assert math.isclose(one["t_statistic"], t) and math.isclose(two["t_statistic"], -t)
    assert one["better_model"] == "b" and one["p_value"] == two["p_value"] and one["significant_at_05"]


def test_constant_differences(spark):
    assert cmp.paired_ttest(scores(spark, [1.0, 2.0], [2.0, 3.0]), "a", "b").first()["p_value"] == 0.0
    same = cmp.paired_ttest(scores(spark, [1.0, 2.0], [1.0, 2.0]), "a", "b").first()
    assert same["p_value"] is None and not same["significant_at_05"] and same["better_model"] == "b"
    assert cmp.paired_ttest(scores(spark, [1.0], [2.0]), "a", "b").count() == 0


def test_best_model_by_size_of_utility(spark):
    s = scores(spark, [-9.0, -9.0], [1.0, 2.0])
    assert cmp.best_model(s).first()["best_model"] == "b"
    assert cmp.best_model(s, by_abs=True).first()["best_model"] == "a"


def test_validate_improvement_lists_fold_scores(spark):
    row = cmp.validate_improvement(scores(spark, [1.0, 2.0], [2.0, 3.0]), "a", "b").first()
    assert row["baseline_scores"] == [1.0, 2.0] and row["improved_scores"] == [2.0, 3.0] and row["meets_target"]
