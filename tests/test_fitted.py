import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from quantloom import Roles
from quantloom.operators import arrays
from quantloom.operators import blending as bl
from quantloom.operators import models as md
from quantloom.operators import selection as se
from quantloom.operators.featureset import feature_names, pack_features
from quantloom.operators.pca import PcaReducer, PcaReducerModel
from quantloom.operators.splits import purged_folds
from quantloom.plans.evaluation import compare_models, cross_validate
from quantloom.plans import feature_prep as FP
from quantloom.plans.feature_prep import feature_prep, fit_feature_prep, prep_summary, reduction_analysis
from quantloom.session import shuffle_partitions

R = Roles()


def array_of(df, column="features"):
    return np.array([r[column] for r in df.orderBy("row_id").collect()], dtype=float)


def table(spark, data):
    data = np.asarray(data, dtype=float)
    pdf = pd.DataFrame(data, columns=[f"feature_{i}" for i in range(data.shape[1])])
    return pack_features(spark.createDataFrame(pdf.assign(row_id=range(len(pdf)))), R)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    base = rng.normal(size=(200, 3)) * [1, 5, 0.3] + [0, 10, -2]
    mixed = base @ rng.normal(size=(3, 3)) + rng.normal(size=(200, 3)) * 0.2
    return np.hstack([base, mixed, np.full((200, 1), 4.0)])


@pytest.mark.parametrize("strategy,want", [("median", 2.0), ("mean", 7 / 3), ("most_frequent", 1.0), ("constant", 0.5)])
def test_imputation(spark, strategy, want):
    nan = np.nan
    df = table(spark, [[1, nan], [nan, nan], [2, nan], [4, nan]])
    got = se.ImputeFeatures(strategy=strategy, fillValue=0.5).fit(df).transform(df)
    assert feature_names(got) == (["feature_0", "feature_1"] if strategy == "constant" else ["feature_0"])
    assert np.isclose(array_of(got)[1, 0], want)


def test_imputation_without_gaps_changes_nothing(spark):
    df = table(spark, [[1.0], [2.0]])
    model = se.ImputeFeatures().fit(df)
    assert not model.getOrDefault("kept") and array_of(model.transform(df)).tolist() == [[1.0], [2.0]]


def greedy(x, threshold):
    corr, var, gone = np.abs(np.corrcoef(x.T)), x.var(axis=0, ddof=1), set()
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            if corr[i, j] >= threshold and not {i, j} & gone:
                gone.add(i if var[i] < var[j] else j)
    return [f"feature_{i}" for i in range(x.shape[1]) if i not in gone]


def test_correlation_filter_is_greedy(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(2, 100))
    x = np.column_stack([a, a * 2 + b * 0.1, a * 3 - b * 0.1, b, b * -0.5, a + b])
    df = table(spark, x)
    model = se.Decorrelate(threshold=0.9).fit(df)
    assert feature_names(model.transform(df)) == greedy(x, 0.9)
    blocks = sorted(tuple(r) for r in se.correlation_pairs(df, 0.9, width=2).collect())
    whole = sorted(tuple(r) for r in se.correlation_pairs(df, 0.9).collect())
    assert [b[:4] for b in blocks] == [w[:4] for w in whole]
    np.testing.assert_allclose([b[4] for b in blocks], [w[4] for w in whole])


def test_low_variance_and_absent_names(spark, data):
    df = table(spark, data)
    model = se.LowVariance(threshold=0.01).fit(df)
    assert feature_names(model.transform(df)) == [f"feature_{i}" for i in range(6)]
    assert feature_names(model.transform(model.transform(df))) == [f"feature_{i}" for i in range(6)]


def test_scaling(spark, data):
    df = table(spark, data)
    z = array_of(se.StandardScale().fit(df).transform(df))
    want = (data - data.mean(axis=0)) / np.where(data.std(axis=0) < 1e-12, 1, data.std(axis=0))
    np.testing.assert_allclose(z, want, atol=1e-9)
    gaps = data.copy()
    gaps[::5, 0] = np.nan
    df = table(spark, gaps)
    zero = np.nan_to_num(gaps)
    q1, q2, q3 = np.quantile(zero, [0.25, 0.5, 0.75], axis=0)
    want = (gaps - q2) / np.where(q3 == q1, 1, q3 - q1)
    np.testing.assert_allclose(array_of(se.RobustScale().fit(df).transform(df)), want, atol=1e-9, equal_nan=True)


@pytest.mark.parametrize("scaled", [True, False])
def test_components(spark, data, scaled, tmp_path):
    df = table(spark, data)
    model = PcaReducer(k=7, scaled=scaled).fit(df)
    z = data - data.mean(axis=0)
    z = z / np.where(z.std(axis=0) < 1e-12, 1, z.std(axis=0)) if scaled else z
    values = np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1]
    np.testing.assert_allclose(model.eigenvalues, values, atol=1e-9)
    np.testing.assert_allclose(model.loadings.T @ model.loadings, np.eye(7), atol=1e-9)
    assert np.isclose(model.ratio.sum(), 1.0)
    scores = array_of(model.transform(df), "pca")
    np.testing.assert_allclose(scores.var(axis=0, ddof=1), values, atol=1e-8)
    np.testing.assert_allclose(scores.mean(axis=0), 0, atol=1e-9)
    assert (model.loadings[np.abs(model.loadings).argmax(axis=0), range(7)] > 0).all()
    errors = [r["reconstruction_error"] for r in model.error(df).collect()]
    assert max(errors) < 1e-18
    few = PcaReducer(variance=0.8, scaled=scaled).fit(df)
    assert few.k == int(np.argmax(np.cumsum(model.ratio) >= 0.8)) + 1
    assert all(r["reconstruction_error"] >= 0 for r in few.error(df).collect())
    few.write().save(str(tmp_path / "pca"))
    again = PcaReducerModel.load(str(tmp_path / "pca"))
    np.testing.assert_allclose(array_of(again.transform(df), "pca"), array_of(few.transform(df), "pca"))
    metrics = few.metrics(spark).first()
    assert metrics["original_dimensions"] == 7 and metrics["reduced_dimensions"] == few.k
    tops = [r["importance"] for r in few.importance(spark).collect()]
    assert tops == sorted(tops, reverse=True)
    assert few.components(spark).first()["component"] == "PC1"


def test_components_reorder_and_require_features(spark, data):
    df = table(spark, data)
    model = PcaReducer(k=2).fit(df)
    swapped = pack_features(
        spark.createDataFrame(
            pd.DataFrame(data[:, ::-1], columns=[f"feature_{i}" for i in range(6, -1, -1)]).assign(row_id=range(200))
        ),
        R,
    )
    np.testing.assert_allclose(array_of(model.transform(swapped), "pca"), array_of(model.transform(df), "pca"), atol=1e-9)
    with pytest.raises(ValueError, match="Missing features"):
        model.transform(table(spark, data[:, :3]))


def test_preparation_uses_fitted_parameters(spark, data, tmp_path):
    gaps = data.copy()
    gaps[0, 0] = np.nan
    pdf = pd.DataFrame(gaps, columns=[f"feature_{i}" for i in range(7)]).assign(row_id=range(200))
    df = spark.createDataFrame(pdf)
    model, out, stats = fit_feature_prep(df, feature_prep(indicators=False, pca=None), R)
    steps = [r["step"] for r in stats.orderBy("position").collect()]
    assert steps == ["input", "imputation", "low_variance_removal", "correlation_removal", "final_scaling", "output"]
    assert "feature_6" not in feature_names(out)
    shifted = spark.createDataFrame(pdf.assign(feature_0=pdf["feature_0"] + 100))
    moved = array_of(model.transform(shifted))[:, 0] - array_of(out)[:, 0]
    assert np.isclose(moved[1:], 100 / np.nanstd(np.where(np.isnan(gaps[:, 0]), np.nanmedian(gaps[:, 0]), gaps[:, 0]))).all()
    model.write().save(str(tmp_path / "prep"))
    np.testing.assert_allclose(array_of(PipelineModel.load(str(tmp_path / "prep")).transform(df)), array_of(out))
    summary = prep_summary(stats).orderBy("position").collect()
    assert summary[0]["features_before"] == 7 and summary[1]["features_removed"] == 1
    assert reduction_analysis(stats).first()["original_features"] == 7


def test_preparation_with_derived_features(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"row_id": range(150), "feature_0": rng.normal(size=150), "feature_1": rng.normal(size=150) + 5})
    prep = feature_prep(lookbacks=[5], quantile_windows=[10])
    _, out, stats = fit_feature_prep(spark.createDataFrame(pdf), prep, R)
    assert out.count() == 150 and feature_names(out)[0] == "pca_0"
    by_step = {r["step"]: r for r in stats.collect()}
    assert by_step["technical_indicators"]["missing_values"] > 0 and by_step["imputation"]["missing_values"] == 0


@pytest.fixture(scope="module")
def separable(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 4))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0).astype(int)
    pdf = pd.DataFrame(x, columns=[f"feature_{i}" for i in range(4)]).assign(
        row_id=range(300), date=np.arange(300) // 10, weight=1.0, resp=np.where(y == 1, 0.1, -0.1), y=y
    )
    return pack_features(spark.createDataFrame(pdf), R, ["date", "weight", "resp", "y"]).cache()


TREES = dict(rounds=4, depth=3, rate=0.5)
HEAD = dict(k=4, hidden=[4], maxIter=30)


def test_boosted_trees(spark, separable, tmp_path):
    model = md.BoostedTrees(**TREES).fit(separable)
    scored = model.transform(separable)
    assert scored.where("pred < 0 or pred > 1").count() == 0
    hits = md.predict(scored).select(F.avg((F.col("predicted") == F.col("y")).cast("int"))).first()[0]
    assert hits > 0.85
    shares = {r["feature"]: r["importance"] for r in md.split_importance(model, separable).collect()}
    assert len(shares) == 4 and np.isclose(sum(shares.values()), 1.0)
    assert md.top_importance(md.gain_importance(model, separable), 2).count() == 2
    history = md.training_history(model, separable, separable).orderBy("round").collect()
    assert history[-1]["train_loss"] < history[0]["train_loss"]
    model.write().save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model")).transform(separable)
    assert again.select("row_id", "pred").exceptAll(scored.select("row_id", "pred")).count() == 0
    with pytest.raises(ValueError, match="Missing features"):
        model.transform(table(spark, [[1.0, 2.0]]))


def test_class_weight_without_positives(spark):
    assert md.class_weight(spark.createDataFrame([(0,)], "y int"), "y").first()["class_weight"] == 1.0


def test_labels_must_be_binary(separable):
    with pytest.raises(ValueError, match="0 and 1"):
        md.BoostedTrees(**TREES).fit(separable.withColumn("y", F.lit(2)))


def test_cross_validation_of_any_estimator(separable):
    plain = Pipeline(stages=[
        md.ToVector(names=[f"feature_{i}" for i in range(4)], outputCol="v"),
        LogisticRegression(featuresCol="v", labelCol="y"),
    ])
    report = cross_validate(plain, separable, purged_folds(separable, "date", 2, gap=1), R).orderBy("fold").collect()
    assert [r["test_size"] for r in report] == [100, 100] and report[0]["train_size"] == 90
    assert all(r["auc"] > 0.9 and r["utility"] > 0 for r in report)


def test_comparing_models(separable):
    models = {"encoder": md.EncoderMlp(**HEAD), "boosted": md.BoostedTrees(**TREES)}
    scores = compare_models(models, separable, purged_folds(separable, "date", 2), R, metrics=("utility", "auc"))
    assert scores.count() == 2 * 2 * 2


def test_utility_evaluator(separable):
    evaluator = md.UtilityEvaluator(predictionCol="y")
    assert evaluator.isLargerBetter()
    gain = separable.where("y = 1").count() * 0.1
    assert np.isclose(evaluator.evaluate(separable.withColumn("y", F.col("y").cast("double"))), gain)


def test_encoder(separable):
    model = md.EncoderMlp(**HEAD).fit(separable)
    assert feature_names(md.encode(model, separable), "encoded") == [f"encoded_{i}" for i in range(4)]
    assert md.anomaly_score(model, separable).where("anomaly_score > 1e-12").count() == 0


def test_blend(spark, separable, tmp_path):
    model = bl.Blend(encoder=md.EncoderMlp(**HEAD), boosted=md.BoostedTrees(**TREES), folds=2).fit(separable)
    assert np.isclose(sum(model.weights.values()), 1.0)
    row = model.contributions(separable, ["row_id"]).first()
    assert np.isclose(row["encoder_contribution"] + row["boosted_contribution"], row["ensemble_pred"])
    assert model.evaluate(separable, R).first()["ensemble_utility"] > 0
    assert model.training_summary(spark).first()["n_members"] == 2
    model.write().save(str(tmp_path / "blend"))
    again = bl.BlendModel.load(str(tmp_path / "blend")).transform(separable)
    assert again.select("row_id", "pred").exceptAll(model.transform(separable).select("row_id", "pred")).count() == 0


def test_blend_weights(spark):
    assert bl.normalise_weights({"a": 1.0, "b": 3.0}) == {"a": 0.25, "b": 0.75}
    df = spark.createDataFrame([(0.2, 0.6)], "a double, b double")
    assert np.isclose(bl.blend(df, ["a", "b"], {"a": 1.0, "b": 3.0}).first()["blend"], 0.5)
    with pytest.raises(ValueError, match="Unknown models"):
        bl.blend(df, ["a", "b"], {"a": 1.0})


def test_weight_search_deals_rows_over_tasks_before_the_grid(spark, monkeypatch):
    """A table in one partition is not scored for every weight by one task."""
    rows = [(i % 3, i % 2, (i * 7 % 101) / 101, (i * 13 % 97) / 97) for i in range(300)] + [(0, 1, None, 0.5), (None, 0, 0.2, 0.3)]
    df = spark.createDataFrame(rows, "fold int, y int, a double, b double").coalesce(1)
    whole = sorted(map(tuple, bl.blend_weight_scores(df, "a", "b", "y").collect()))
    parts, real = [], bl.auc
    monkeypatch.setattr(bl, "auc", lambda tried, *rest: parts.append(tried.rdd.getNumPartitions()) or real(tried, *rest))
    monkeypatch.setattr(bl, "TASK_SCORES", 1000, raising=False)
    again = sorted(map(tuple, bl.blend_weight_scores(df, "a", "b", "y").collect()))
    assert parts[0] >= 302 * len(bl.GRID) / 1000
    assert len(parts) == 1
    monkeypatch.setattr(bl, "PART_SCORES", 302 * len(bl.GRID) // (3 * shuffle_partitions(spark)) + 1)
    passes = sorted(map(tuple, bl.blend_weight_scores(df, "a", "b", "y").collect()))
    assert len(parts) == 1 + 3
    for made in (again, passes):
        assert [w for w, _ in made] == [w for w, _ in whole]
        assert [a for _, a in made] == pytest.approx([a for _, a in whole])


def test_prepared_components_are_computed_once(spark, monkeypatch):
    """The prepared table is read back, not projected by Python again for each count and for its reader."""
    counted, real = [], FP.stage_stats
    monkeypatch.setattr(FP, "stage_stats", lambda df, step, *rest: counted.append((step, df)) or real(df, step, *rest))
    rng = np.random.default_rng(3)
    rows = [(i, *map(float, rng.normal(size=4))) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, feature_0 double, feature_1 double, feature_2 double, feature_3 double")
    _, out, stats = fit_feature_prep(df, feature_prep(indicators=False, pca=0.95), Roles(n_features=4))
    plans = [t._jdf.queryExecution().optimizedPlan().toString() for t in (out, *(t for _, t in counted))]
    assert not any("ArrowEvalPython" in p for p in plans)
    assert out.count() == 60 and sum(step == "output" for step, _ in counted) == 0
    noted = [tuple(r) for r in stats.orderBy("position").collect()]
    assert noted[-1][1:2] == ("output",) and noted[-1][2:] == noted[-2][2:] and noted[-1][0] == len(noted) - 1


def test_correlations_of_full_and_gappy_batches(spark):
    """Batches without a gap are summed per feature, others per pair; together they are the rows' correlations."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 3)) @ np.array([[1, 0.9, 0.2], [0, 0.4, 0.1], [0, 0, 1]]) + 50
    x[60:][rng.random((30, 3)) < 0.3] = np.nan
    rows = [(i, *(None if np.isnan(v) else float(v) for v in r)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "row_id long, feature_0 double, feature_1 double, feature_2 double")
    packed = pack_features(df.repartitionByRange(6, "row_id"), Roles(n_features=3))
    found = {(r.i, r.j): r.correlation for r in se.correlation_pairs(packed, 0.0).collect()}
    wanted = pd.DataFrame(x).corr().abs()
    assert found == pytest.approx({(i, j): wanted[i][j] for i in range(3) for j in range(i + 1, 3)})


def test_preparation_makes_no_row_per_element(spark, monkeypatch):
    """Medians, variances and correlations come from whole arrays, each table's statistics from one pass."""
    passes, real = [], se.feature_stats
    monkeypatch.setattr(arrays, "feature_stats", lambda *a: passes.append(1) or real(*a))
    monkeypatch.setattr(se, "cells", lambda *a: pytest.fail("a row per element"))
    monkeypatch.setattr(se, "exact_quantiles", lambda *a: pytest.fail("a row per element"))
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 5)) * [1, 2, 0.01, 3, 1]
    x[:, 3] = 2 * x[:, 0] + 0.01 * x[:, 3]
    gaps = x.copy()
    gaps[::7, 1] = np.nan
    pdf = pd.DataFrame(gaps, columns=[f"feature_{i}" for i in range(5)]).assign(row_id=range(120))
    model, out, stats = fit_feature_prep(spark.createDataFrame(pdf), feature_prep(indicators=False, pca=0.999), R)
    assert model.stages[1].getOrDefault("fills")[1] == pytest.approx(np.nanmedian(gaps[:, 1]))
    assert model.stages[2].getOrDefault("dropped") == ["feature_2"]
    assert model.stages[3].getOrDefault("dropped") == ["feature_0"]
    filled = np.where(np.isnan(gaps), np.nanmedian(gaps, axis=0), gaps)[:, [1, 3, 4]]
    z = (filled - filled.mean(axis=0)) / filled.std(axis=0)
    np.testing.assert_allclose(array_of(out).var(axis=0, ddof=1), np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1], atol=1e-9)
    assert [(r["n_samples"], r["missing_values"]) for r in stats.orderBy("position").collect()] == [(120, 18)] + [(120, 0)] * 5
    assert len(passes) == 1


def test_statistics_of_filled_and_picked_features(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(80, 4)) + 1e6
    x[rng.random((80, 4)) < 0.3] = np.nan
    x[:, 2], x[:, 3] = 0.1, np.nan
    df = table(spark, x).repartition(5)
    before, fills = arrays.stats_of(df, "features", 4), [1.0, 2e6, 5.0, 4.0]
    after = np.where(np.isnan(x), fills, x)[:, [3, 1, 0, 2]]
    made = df.select(arrays.pick_elements(arrays.fill_elements("features", fills), [3, 1, 0, 2], 4).alias("features"))
    again = arrays.stats_of(made, "features", 4)
    for found in (before.filled(fills).picked([3, 1, 0, 2]), again):
        assert found.rows == 80 and not found.missing.any()
        np.testing.assert_allclose(found.mean, after.mean(axis=0), rtol=1e-12)
        np.testing.assert_allclose(found.variance(), after.var(axis=0, ddof=1), rtol=1e-9, atol=1e-18)
        assert (found.low == after.min(axis=0)).all() and (found.high == after.max(axis=0)).all()
    assert before.variance()[2] == 0.0 and np.isnan(before.variance()[3]) and before.missing[3] == 80


def test_components_need_whole_rows(spark):
    with pytest.raises(ValueError, match="missing values"):
        PcaReducer(k=1).fit(table(spark, [[1.0, np.nan], [2.0, 3.0], [0.0, 1.0]]))
