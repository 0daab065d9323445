"""Fitted feature stages, components, models and blends."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.evaluation import LABELLED, auc_sql, labelled, taken
from checks.views import (
    CELLS_SQL,
    TICK_FEATURES,
    TICKS_SQL,
    WIDE_CELLS_SQL,
    WIDE_SQL,
    WIDTH,
    round_sql,
    rounded,
    ticks,
    wide,
)
from quantloom import Roles
from quantloom.operators import blending as bl
from quantloom.operators import models as md
from quantloom.operators import selection as se
from quantloom.operators import splits as sp
from quantloom.operators.comparison import comparison_summary
from quantloom.operators.featureset import feature_names, feature_values, pack_features
from quantloom.operators.pca import PcaReducer
from quantloom.plans.evaluation import compare_models, cross_validate
from quantloom.plans.feature_prep import (
    feature_prep,
    fit_feature_prep,
    prep_summary,
    reduction_analysis,
)
from quantloom.session import checkpoint_root, materialise

R = Roles()
TREES = dict(rounds=5, depth=3, rate=0.3)
HEAD = dict(k=16, hidden=[16, 8], maxIter=20)


def packed(spark, sf) -> DataFrame:
    return pack_features(ticks(spark, sf), R)


def values(df: DataFrame) -> DataFrame:
    return rounded(feature_values(df, ["row_id"]))


def impute(strategy: str):
    def run(spark, sf):
        table = packed(spark, sf)
        return values(se.ImputeFeatures(strategy=strategy, fillValue=-1.5).fit(table).transform(table))

    return run


def impute_sql(fill: str, source: str = "known") -> str:
    return f"""WITH {CELLS_SQL}, known AS (SELECT * FROM cells WHERE x IS NOT NULL),
      fills AS (SELECT feature, {fill} AS fill FROM {source} GROUP BY feature),
      out AS (SELECT row_id, feature, coalesce(x, fill) AS value FROM cells JOIN fills USING (feature)) """ + round_sql(
        "out", ["row_id", "feature"], ["value"]
    )


def wide_packed(spark, sf) -> DataFrame:
    return pack_features(wide(spark, sf), R, ["date", "y"])


# Linear combinations of the features make correlated and nearly constant columns.
EXTRA = {
    "feature_100": ("feature_0 * 2e0 + feature_1 * 0.01e0", "feature_0 * 2e0 + feature_1 * 0.01e0"),
    "feature_101": ("feature_0 * -1e0 + feature_2 * 0.05e0", "feature_0 * -1e0 + feature_2 * 0.05e0"),
    "feature_102": ("feature_3 * 0.01e0", "feature_3 * 0.01e0"),
    "feature_103": ("feature_4 + feature_5 * 0.1e0", "feature_4 + feature_5 * 0.1e0"),
    "feature_104": ("feature_4 - feature_5 * 0.1e0", "feature_4 - feature_5 * 0.1e0"),
}
RELATED = [f"feature_{i}" for i in range(WIDTH)] + list(EXTRA)


def related(spark, sf) -> DataFrame:
    table = wide(spark, sf).withColumns({n: F.expr(s) for n, (s, _) in EXTRA.items()})
    return pack_features(table.select("row_id", *RELATED), R)


RELATED_SQL = (
    f"{WIDE_SQL}, related AS (SELECT row_id, {', '.join(f'feature_{i}' for i in range(WIDTH))}, "
    + ", ".join(f"{sql} AS {n}" for n, (_, sql) in EXTRA.items())
    + " FROM wide), rel AS ("
    + " UNION ALL ".join(
        f"SELECT row_id, {i} AS i, '{n}' AS feature, {n} AS x FROM related" for i, n in enumerate(RELATED)
    )
    + ")"
)
PAIRS_SQL = """pairs AS (SELECT a.i AS i, b.i AS j, a.feature AS a, b.feature AS b, abs(corr(a.x, b.x)) AS correlation
  FROM rel a JOIN rel b ON a.row_id = b.row_id AND a.i < b.i GROUP BY ALL HAVING abs(corr(a.x, b.x)) >= 0.95)"""


def survivors(stage):
    def run(spark, sf):
        table = related(spark, sf)
        kept = feature_names(stage().fit(table).transform(table))
        return table.select(F.explode(F.array(*[F.lit(n) for n in kept])).alias("feature")).groupBy(
            "feature"
        ).agg(F.count("*").alias("rows"))

    return run


def pairs(spark, sf):
    return rounded(se.correlation_pairs(related(spark, sf), 0.95))


def pairs_in_blocks(spark, sf):
    return rounded(se.correlation_pairs(related(spark, sf), 0.95, width=40))


def scaled(stage):
    def run(spark, sf):
        table = packed(spark, sf)
        return values(stage().fit(table).transform(table))

    return run


def prepared(spark, sf):
    """Imputation and scaling fitted on the early rows and applied to the later ones."""
    table = ticks(spark, sf)
    prep = feature_prep(indicators=False, pca=None)
    model = prep.fit(table.where("date < 20"))
    return values(model.transform(table.where("date >= 20")))


def prep_statistics(pick):
    def run(spark, sf):
        prep = feature_prep(indicators=False, pca=None)
        _, _, stats = fit_feature_prep(ticks(spark, sf), prep, R)
        return rounded(pick(stats))

    return run


def full_prep(spark, sf):
    """Derived features, imputation, selection and components over all ticks."""
    prep = feature_prep(lookbacks=[5, 10], quantile_windows=[20], keep=["date"])
    _, out, _ = fit_feature_prep(ticks(spark, sf), prep, R)
    return rounded(feature_values(out, ["row_id", "date"]), 4)


def components(run):
    return lambda spark, sf: rounded(run(spark, wide_packed(spark, sf)))


def pca_scores(spark, table):
    return PcaReducer(variance=0.95).fit(table).transform(table).select("row_id", F.explode("pca").alias("score"))


def pca_norms(spark, table):
    """All components: the squared length of a row is that of its standardised features."""
    made = PcaReducer(k=64).fit(table).transform(table)
    length = F.aggregate("pca", F.lit(0.0), lambda acc, x: acc + x * x)
    return made.select("row_id", length.alias("squared_length"))


def pca_inverse(spark, table):
    """All components restore the features."""
    model = PcaReducer(k=64).fit(table)
    return feature_values(model.inverse(model.transform(table)), ["row_id"], "restored")


def pca_error(spark, table):
    return PcaReducer(k=8).fit(table).error(table).select("row_id", "reconstruction_error")


def pca_exact_error(spark, table):
    return PcaReducer(k=64).fit(table).error(table).select("row_id", "reconstruction_error")


def training_table(spark, sf) -> DataFrame:
    """Wide features with weights and returns, stored as every fold reads it."""
    table = wide(spark, sf).withColumns(
        {
            "weight": F.expr("1e0 + 0.5e0 * (row_id % 5)"),
            "resp": F.expr("((row_id * 7919) % 201 - 100) / 1000.0e0"),
        }
    )
    return materialise(pack_features(table, R, ["date", "weight", "resp", "y"]), "training")


def boosted(spark, sf):
    table = training_table(spark, sf)
    return md.BoostedTrees(**TREES).fit(table), table


def boosted_predictions(spark, sf):
    model, table = boosted(spark, sf)
    made = md.predict(model.transform(table))
    return rounded(made.select("row_id", "pred", "predicted"))


def model_round_trip(spark, sf):
    """Scores of the fitted model minus those of the model saved and loaded."""
    model, table = boosted(spark, sf)
    path = f"{checkpoint_root(spark)}/checks/model-{uuid.uuid4().hex}"
    model.write().save(path)
    again = PipelineModel.load(path).transform(table).select("row_id", F.col("pred").alias("again"))
    both = model.transform(table).select("row_id", "pred").join(again, "row_id")
    return both.select("row_id", F.round(F.col("pred") - F.col("again"), 9).alias("difference"))


def boosted_history(spark, sf):
    model, table = boosted(spark, sf)
    flagged = sp.holdout(table, "y", 0.2, 42)
    return rounded(md.training_history(model, flagged.where("not is_validation"), flagged.where("is_validation")))


def boosted_importance(spark, sf):
    model, table = boosted(spark, sf)
    return rounded(md.split_importance(model, table))


def boosted_top(spark, sf):
    model, table = boosted(spark, sf)
    return rounded(md.top_importance(md.gain_importance(model, table), 10))


def encoded(run):
    def query(spark, sf):
        table = training_table(spark, sf)
        return rounded(run(md.EncoderMlp(**HEAD).fit(table), table))

    return query


def cross_validation(spark, sf):
    table = training_table(spark, sf)
    return rounded(cross_validate(md.BoostedTrees(**TREES), table, sp.purged_folds(table, "date", 2, gap=1), R))


def model_comparison(spark, sf):
    table = training_table(spark, sf)
    models = {"encoder": md.EncoderMlp(**HEAD), "boosted": md.BoostedTrees(**TREES)}
    return rounded(
        comparison_summary(compare_models(models, table, sp.purged_folds(table, "date", 2), R), ["utility", "auc"])
    )


def evaluator(spark, sf):
    table = ticks(spark, sf)
    days = [
        (name, md.UtilityEvaluator(predictionCol=name).evaluate(table)) for name in ("pred", "pred_b")
    ]
    return rounded(spark.createDataFrame(days, "score string, utility double"))


def blended_model(spark, sf):
    table = training_table(spark, sf)
    made = bl.Blend(encoder=md.EncoderMlp(**HEAD), boosted=md.BoostedTrees(**TREES), folds=2).fit(table)
    return made, table


def blend_fit(spark, sf):
    model, table = blended_model(spark, sf)
    return rounded(model.contributions(table, ["row_id"]))


def blend_summary(spark, sf):
    model, _ = blended_model(spark, sf)
    made = model.training_summary(spark)
    return made.select("n_members", F.to_json("initial_weights").alias("initial_weights"), F.to_json("final_weights").alias("final_weights"), "weights_optimised")


MEMBERS, WEIGHTS = ["pred", "pred_b"], {"pred": 0.3, "pred_b": 0.7}
UNEVEN = {"pred": 1.0, "pred_b": 0.5, "unused": 2.0}


def weight_search(spark, sf):
    rows = sp.with_stratified_fold(labelled(spark, sf), "y", 3, 42, exact=False)
    return rounded(bl.blend_weight_scores(rows, "pred", "pred_b", "y"))


def best_weight(spark, sf):
    rows = sp.with_stratified_fold(labelled(spark, sf), "y", 3, 42, exact=False)
    return rounded(bl.search_blend_weight(rows, "pred", "pred_b", "y"))


def blend_gain(spark, sf):
    table = bl.blend(ticks(spark, sf), MEMBERS, WEIGHTS)
    return rounded(bl.evaluate_blend(table, "blend", "pred_b", R))


QUERIES = {
    "impute_median": impute("median"),
    "impute_mean": impute("mean"),
    "impute_most_frequent": impute("most_frequent"),
    "impute_constant": impute("constant"),
    "low_variance": survivors(lambda: se.LowVariance(threshold=0.0005)),
    "feature_variances": lambda spark, sf: rounded(se.feature_variances(packed(spark, sf))),
    "correlation_pairs": pairs,
    "correlation_pairs_in_blocks": pairs_in_blocks,
    "correlation_filter": survivors(lambda: se.Decorrelate(threshold=0.95)),
    "standard_scale": scaled(se.StandardScale),
    "robust_scale": scaled(se.RobustScale),
    "prep_transform": prepared,
    "prep_stage_stats": prep_statistics(lambda s: s),
    "prep_summary": prep_statistics(prep_summary),
    "prep_reduction": prep_statistics(reduction_analysis),
    "prep_with_components": full_prep,
    "pca_scores": components(pca_scores),
    "pca_row_norms": components(pca_norms),
    "pca_inverse": components(pca_inverse),
    "pca_reconstruction_error": components(pca_error),
    "pca_exact_reconstruction": components(pca_exact_error),
    "pca_importance": components(lambda spark, t: PcaReducer().fit(t).importance(spark)),
    "pca_components": components(lambda spark, t: PcaReducer().fit(t).components(spark)),
    "pca_metrics": components(lambda spark, t: PcaReducer().fit(t).metrics(spark)),
    "class_weight": lambda spark, sf: rounded(md.class_weight(wide(spark, sf), "y")),
    "boosted_predictions": boosted_predictions,
    "boosted_split_importance": boosted_importance,
    "boosted_top_importance": boosted_top,
    "boosted_history": boosted_history,
    "model_round_trip": model_round_trip,
    "encoded_features": encoded(lambda m, t: feature_values(md.encode(m, t), ["row_id"], "encoded")),
    "encoder_predictions": encoded(lambda m, t: m.transform(t).select("row_id", "pred")),
    "anomaly_score": encoded(lambda m, t: md.anomaly_score(m, t).select("row_id", "anomaly_score")),
    "cross_validation": cross_validation,
    "model_comparison": model_comparison,
    "utility_evaluator": evaluator,
    "stored_table": lambda spark, sf: rounded(materialise(ticks(spark, sf).select("row_id", "pred"))),
    "blend": lambda spark, sf: rounded(
        bl.blend(ticks(spark, sf), MEMBERS, UNEVEN).select("row_id", "blend")
    ),
    "blend_contributions": lambda spark, sf: rounded(
        bl.contributions(ticks(spark, sf), MEMBERS, WEIGHTS, ["row_id"])
    ),
    "blend_weight_scores": weight_search,
    "blend_best_weight": best_weight,
    "blend_evaluation": blend_gain,
    "blend_fit": blend_fit,
    "blend_training_summary": blend_summary,
}

POP = "avg(x) OVER (PARTITION BY feature)", "stddev_pop(x) OVER (PARTITION BY feature)"
IQR = ", ".join(
    f"quantile_cont(coalesce(x, 0), {q}) OVER (PARTITION BY feature) AS {n}"
    for n, q in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))
)
HASH_FOLD = "('0x' || substr(md5(row_id || ':42'), 1, 8))::BIGINT % 3"
TRIED = f"""{LABELLED}, grid AS (SELECT unnest(range(21)) / 20e0 AS w),
  tried AS (SELECT w AS weight, {HASH_FOLD} AS fold, y, w * pred + (1 - w) * pred_b AS mixed FROM labelled, grid),
  scored AS ({auc_sql('tried', 'weight, fold', 'mixed')}),
  means AS (SELECT weight, avg(auc) AS mean_auc FROM scored GROUP BY weight)"""

SQL = {
    "impute_median": impute_sql("median(x)"),
    "impute_mean": impute_sql("avg(x)"),
    "impute_most_frequent": impute_sql(
        "arg_min(x, (-n, x))", "(SELECT feature, x, count(*) AS n FROM known GROUP BY feature, x)"
    ),
    "impute_constant": f"WITH {CELLS_SQL}, out AS (SELECT row_id, feature, coalesce(x, -1.5e0) AS value FROM cells) "
    + round_sql("out", ["row_id", "feature"], ["value"]),
    "low_variance": f"WITH {RELATED_SQL} SELECT feature, count(*) AS rows FROM rel GROUP BY feature HAVING var_samp(x) > 0.0005",
    "feature_variances": f"WITH {CELLS_SQL}, out AS (SELECT replace(feature, 'feature_', '')::INTEGER AS f, "
    "var_samp(x) AS variance FROM cells GROUP BY feature) " + round_sql("out", ["f"], ["variance"]),
    "correlation_pairs": f"WITH {RELATED_SQL}, {PAIRS_SQL} " + round_sql("pairs", ["i", "j", "a", "b"], ["correlation"]),
    # The greedy pass as a recursion over the pairs in order.
    "correlation_filter": f"""WITH RECURSIVE {RELATED_SQL}, {PAIRS_SQL},
      spread AS (SELECT i, var_samp(x) AS v FROM rel GROUP BY i),
      ordered AS (SELECT row_number() OVER (ORDER BY p.i, p.j) AS k, p.i, p.j, a.v AS vi, b.v AS vj
        FROM pairs p JOIN spread a ON a.i = p.i JOIN spread b ON b.i = p.j),
      walk AS (SELECT 0::BIGINT AS k, []::INTEGER[] AS gone UNION ALL
        SELECT o.k, CASE WHEN list_contains(gone, o.i) OR list_contains(gone, o.j) THEN gone
          ELSE list_append(gone, CASE WHEN vi < vj THEN o.i ELSE o.j END) END
        FROM walk JOIN ordered o ON o.k = walk.k + 1),
      final AS (SELECT gone FROM walk ORDER BY k DESC LIMIT 1)
      SELECT feature, count(*) AS rows FROM rel, final WHERE NOT list_contains(gone, i) GROUP BY feature""",
    "standard_scale": f"WITH {CELLS_SQL}, out AS (SELECT row_id, feature, (x - {POP[0]}) / {POP[1]} AS value FROM cells) "
    + round_sql("out", ["row_id", "feature"], ["value"]),
    "robust_scale": f"WITH {CELLS_SQL}, q AS (SELECT *, {IQR} FROM cells), out AS (SELECT row_id, feature, "
    "(x - q2) / CASE WHEN q3 = q1 THEN 1 ELSE q3 - q1 END AS value FROM q) "
    + round_sql("out", ["row_id", "feature"], ["value"]),
    "prep_transform": f"""WITH {CELLS_SQL}, dated AS (SELECT cells.*, date FROM cells JOIN ticks USING (row_id)),
      fills AS (SELECT feature, median(x) AS fill FROM dated WHERE date < 20 GROUP BY feature),
      filled AS (SELECT row_id, date, feature, coalesce(x, fill) AS x FROM dated JOIN fills USING (feature)),
      fit AS (SELECT feature, avg(x) AS m, stddev_pop(x) AS s FROM filled WHERE date < 20 GROUP BY feature),
      out AS (SELECT row_id, feature, (x - m) / s AS value FROM filled JOIN fit USING (feature) WHERE date >= 20) """
    + round_sql("out", ["row_id", "feature"], ["value"]),
    "pca_row_norms": f"""WITH {WIDE_CELLS_SQL}, z AS (SELECT row_id, (x - avg(x) OVER (PARTITION BY f))
      / stddev_pop(x) OVER (PARTITION BY f) AS z FROM wide_cells),
      out AS (SELECT row_id, sum(z * z) AS squared_length FROM z GROUP BY row_id) """
    + round_sql("out", ["row_id"], ["squared_length"]),
    "pca_inverse": f"WITH {WIDE_CELLS_SQL}, out AS (SELECT row_id, 'feature_' || f AS feature, x AS value FROM wide_cells) "
    + round_sql("out", ["row_id", "feature"], ["value"]),
    "pca_exact_reconstruction": "SELECT vec_id AS row_id, 0e0 AS reconstruction_error FROM embeddings",
    "class_weight": f"""WITH {WIDE_SQL}, out AS (SELECT count_if(y = 0)::BIGINT AS negatives, count_if(y = 1)::BIGINT AS positives,
      count_if(y = 0) / count_if(y = 1)::DOUBLE AS class_weight FROM wide) """
    + round_sql("out", ["negatives", "positives"], ["class_weight"]),
    "model_round_trip": "SELECT vec_id AS row_id, 0e0 AS difference FROM embeddings",
    "utility_evaluator": f"WITH {TICKS_SQL}, out AS ("
    + " UNION ALL ".join(
        f"SELECT '{p}' AS score, sum(resp * weight * {taken(p)}) AS utility FROM ticks" for p in ("pred", "pred_b")
    )
    + ") "
    + round_sql("out", ["score"], ["utility"]),
    "stored_table": f"WITH {TICKS_SQL} " + round_sql("ticks", ["row_id"], ["pred"]),
    "blend": f"WITH {TICKS_SQL}, out AS (SELECT row_id, (pred * 1e0 + pred_b * 0.5e0) / 1.5e0 AS blend FROM ticks) "
    + round_sql("out", ["row_id"], ["blend"]),
    "blend_contributions": f"""WITH {TICKS_SQL}, out AS (SELECT row_id, pred AS pred_pred, pred_b AS pred_b_pred,
      pred * 0.3e0 AS pred_contribution, pred_b * 0.7e0 AS pred_b_contribution,
      pred * 0.3e0 + pred_b * 0.7e0 AS ensemble_pred, 0.3e0 AS pred_weight, 0.7e0 AS pred_b_weight FROM ticks) """
    + round_sql(
        "out",
        ["row_id"],
        ["pred_pred", "pred_b_pred", "pred_contribution", "pred_b_contribution", "ensemble_pred", "pred_weight", "pred_b_weight"],
    ),
    "blend_weight_scores": f"WITH {TRIED} " + round_sql("means", [], ["weight", "mean_auc"]),
    "blend_best_weight": f"""WITH {TRIED}, out AS (SELECT weight AS first_weight, 1 - weight AS second_weight, mean_auc
      FROM means ORDER BY mean_auc DESC, weight LIMIT 1) """
    + round_sql("out", [], ["first_weight", "second_weight", "mean_auc"]),
    "blend_evaluation": f"""WITH {TICKS_SQL}, mixed AS (SELECT *, pred * 0.3e0 + pred_b * 0.7e0 AS b FROM ticks),
      u AS (SELECT sum(resp * weight * {taken('b')}) AS e, sum(resp * weight * {taken('pred_b')}) AS p FROM mixed),
      out AS (SELECT e AS ensemble_utility, p AS baseline_utility, e - p AS absolute_improvement,
        (e - p) / abs(p) * 100 AS improvement_percentage, (e - p) / abs(p) * 100 >= 12 AS meets_target FROM u) """
    + round_sql(
        "out",
        ["meets_target"],
        ["ensemble_utility", "baseline_utility", "absolute_improvement", "improvement_percentage"],
    ),
}
# No two of the three tick features are correlated, so each qualifying pair would drop one feature.
STATS = f"""WITH {CELLS_SQL}, fills AS (SELECT feature, median(x) AS fill FROM cells GROUP BY feature),
  filled AS (SELECT row_id, feature, coalesce(x, fill) AS x FROM cells JOIN fills USING (feature)),
  spread AS (SELECT feature FROM filled GROUP BY feature HAVING var_samp(x) > 0.01),
  close_pairs AS (SELECT a.feature FROM filled a JOIN filled b ON a.row_id = b.row_id AND a.feature < b.feature
    GROUP BY a.feature, b.feature HAVING abs(corr(a.x, b.x)) >= 0.95),
  sizes AS (SELECT count(DISTINCT row_id) AS n, count(DISTINCT feature) AS d, count(*) - count(x) AS gaps FROM cells),
  low AS (SELECT count(*) AS d FROM spread), near AS (SELECT low.d - (SELECT count(*) FROM close_pairs) AS d FROM low),
  steps AS (SELECT 0 AS position, 'input' AS step, d, gaps FROM sizes
    UNION ALL SELECT 1, 'imputation', d, 0 FROM sizes
    UNION ALL SELECT 2, 'low_variance_removal', d, 0 FROM low
    UNION ALL SELECT 3, 'correlation_removal', d, 0 FROM near
    UNION ALL SELECT 4, 'final_scaling', d, 0 FROM near
    UNION ALL SELECT 5, 'output', d, 0 FROM near),
  stats AS (SELECT position, step, steps.d::INTEGER AS n_features, n AS n_samples, steps.gaps::BIGINT AS missing_values,
    steps.gaps * 100e0 / (n * steps.d) AS missing_percentage, n * steps.d * 8e0 / 1024 / 1024 AS memory_usage_mb
    FROM steps, sizes)"""
SQL["prep_stage_stats"] = f"{STATS} " + round_sql(
    "stats", ["position", "step", "n_features", "n_samples", "missing_values"], ["missing_percentage", "memory_usage_mb"]
)
SQL["prep_summary"] = (
    f"""{STATS}, moved AS (SELECT *, lag(n_features) OVER (ORDER BY position) AS before FROM stats),
  out AS (SELECT position, step, before AS features_before, n_features AS features_after,
    before - n_features AS features_removed, (before - n_features) * 100e0 / before AS removal_percentage,
    missing_percentage, memory_usage_mb FROM moved WHERE step NOT IN ('input', 'output')) """
    + round_sql(
        "out",
        ["position", "step", "features_before", "features_after", "features_removed"],
        ["removal_percentage", "missing_percentage", "memory_usage_mb"],
    )
)
SQL["prep_reduction"] = (
    f"""{STATS}, ends AS (SELECT max(n_features) FILTER (step = 'input') AS original_features,
    max(n_features) FILTER (step = 'output') AS final_features FROM stats),
  out AS (SELECT *, final_features / original_features::DOUBLE AS reduction_ratio,
    (1 - final_features / original_features::DOUBLE) * 100 AS reduction_percentage FROM ends) """
    + round_sql("out", ["original_features", "final_features"], ["reduction_ratio", "reduction_percentage"])
)
SQL["correlation_pairs_in_blocks"] = SQL["correlation_pairs"]
