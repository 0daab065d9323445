"""Splits, utility, scores and model comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.views import TICKS_SQL, TRADES_SQL, raw_ticks, round_sql, rounded, ticks, trades
from quantloom import Roles
from quantloom.operators import comparison as cmp
from quantloom.operators import scoring as sc
from quantloom.operators import splits as sp
from quantloom.operators import utility as ut
from quantloom.operators.cleaning import with_target
from quantloom.session import materialise

R = Roles()
N = 5
METRICS = ("utility", "auc", "accuracy", "precision", "recall")


def labelled(spark, sf):
    return with_target(ticks(spark, sf), R)


def loose(spark, sf):
    """Labelled ticks for what needs no row order."""
    return with_target(raw_ticks(spark, sf), R)


def split_query(**kw):
    return lambda spark, sf: sp.purged_splits(ticks(spark, sf), "date", N, **kw).select(
        "fold", "role", "row_id", "date"
    )


def time_series(spark, sf):
    t = ticks(spark, sf)
    return sp.assign(t, sp.time_series_folds(t, "row_id", N)).select("fold", "role", "row_id")


def stratified(spark, sf):
    t = sp.with_stratified_fold(labelled(spark, sf), "y", N, 42)
    return t.select("row_id", "y", "fold")


def stratified_hash(spark, sf):
    t = sp.with_stratified_fold(labelled(spark, sf), "y", N, 42, exact=False)
    return t.select("row_id", "y", "fold")


def holdout(spark, sf):
    return sp.holdout(labelled(spark, sf), "y", 0.2, 42).select("row_id", "y", "is_validation")


def improvement_by_day(spark, sf):
    t = raw_ticks(spark, sf)
    both = t.groupBy("date").agg(
        ut.utility_columns(F.col("pred"), R).alias("base"),
        ut.utility_columns(F.col("pred_b"), R).alias("model"),
    )
    pct = ut.improvement(F.col("base"), F.col("model"))
    return rounded(both.select("date", "base", "model", pct.alias("improvement_pct")))


def whole_decisions(spark, sf):
    """Scores that are already decisions: nothing lies strictly between 0 and 1."""
    t = trades(spark, sf).withColumn("choice", F.floor(F.col("pred") * 3).cast("double"))
    return rounded(ut.utility(t, "choice", R, ["date"]))


def report(spark, sf):
    t = loose(spark, sf)
    return rounded(sc.fold_report(t, sp.purged_folds(t, "date", N), "pred", "y", R, METRICS))


def out_of_fold(spark, sf):
    t = labelled(spark, sf)
    return rounded(sc.fold_predictions(t, sp.purged_folds(t, "date", N), "pred", "y"))


def scores(spark, sf):
    """Fold scores of two score columns as the models ``boosted`` and ``blend``."""
    t = loose(spark, sf)
    folds = sp.purged_folds(t, "date", N)
    made = [
        sc.fold_scores(sc.fold_report(t, folds, pred, "y", R, METRICS), model, METRICS)
        for model, pred in (("boosted", "pred"), ("blend", "pred_b"))
    ]
    return materialise(made[0].unionByName(made[1]), "scores")


def on_scores(fn):
    return lambda spark, sf: rounded(fn(scores(spark, sf)))


FOLDS_SQL = """groups AS (
  SELECT date, ntile(6) OVER (ORDER BY date) - 1 AS chunk FROM (SELECT DISTINCT date FROM ticks)),
members AS (
  SELECT fold::INTEGER AS fold, CASE WHEN chunk <= fold THEN 'train' ELSE 'test' END AS role, date
  FROM (SELECT unnest(range(5)) AS fold) JOIN groups ON chunk <= fold + 1)"""
LABELLED = f"{TICKS_SQL}, labelled AS (SELECT *, coalesce(resp > 0, false)::INTEGER AS y FROM ticks)"
TESTED = f"""{LABELLED}, {FOLDS_SQL},
tested AS (SELECT fold, labelled.* FROM members JOIN labelled USING (date) WHERE role = 'test')"""


def auc_sql(source: str, by: str, pred: str = "pred", name: str = "auc") -> str:
    return f"""SELECT {by}, CASE WHEN sum(y) IN (0, count(*)) THEN 0.5e0 ELSE
      (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2e0) / (sum(y)::DOUBLE * (count(*) - sum(y)))
      END AS {name}
    FROM (SELECT {by}, y, rank() OVER (PARTITION BY {by} ORDER BY {pred})
      + (count(*) OVER (PARTITION BY {by}, {pred}) - 1) / 2e0 AS r FROM {source}) GROUP BY {by}"""


def taken(pred: str) -> str:
    return f"({pred} >= 0.5e0)::BIGINT"


def plain_metrics(pred: str) -> str:
    return f"""coalesce(sum(resp * weight * {taken(pred)}), 0) AS utility,
  avg(({taken(pred)} = y)::INTEGER) AS accuracy,
  coalesce(sum({taken(pred)} * y) / nullif(sum({taken(pred)}), 0)::DOUBLE, 0e0) AS "precision",
  coalesce(sum({taken(pred)} * y) / nullif(sum(y), 0)::DOUBLE, 0e0) AS recall"""


def _scores_sql() -> str:
    parts = []
    for model, pred in (("boosted", "pred"), ("blend", "pred_b")):
        parts.append(
            f"m_{model} AS (SELECT fold, {plain_metrics(pred)} FROM tested GROUP BY fold), "
            f"a_{model} AS ({auc_sql('tested', 'fold', pred)})"
        )
    union = " UNION ALL ".join(
        f"SELECT '{model}' AS model, fold, '{m}' AS metric, \"{m}\" AS score FROM m_{model} JOIN a_{model} USING (fold)"
        for model in ("boosted", "blend")
        for m in METRICS
    )
    return f"WITH {TESTED}, {', '.join(parts)}, scores AS ({union})"


SCORES = _scores_sql()
PAIRED = f"""{SCORES}, pairs AS (
  SELECT metric, a.fold, a.score AS a, b.score AS b FROM scores a JOIN scores b USING (metric, fold)
  WHERE a.model = 'boosted' AND b.model = 'blend'),
tests AS (SELECT metric, avg(a) AS mean_a, avg(b) AS mean_b, avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))) AS t
  FROM pairs GROUP BY metric),
tested_pairs AS (SELECT metric, mean_a, mean_b, t,
  1 - abs(t) / sqrt(4 + t * t) * (1 + 2 / (4 + t * t)) AS p,
  CASE WHEN mean_a > mean_b THEN 'boosted' ELSE 'blend' END AS better FROM tests)"""
PCT = """CASE WHEN mean_a = 0 THEN CASE WHEN mean_b > 0 THEN 100e0 ELSE 0e0 END
  ELSE (mean_b - mean_a) / abs(mean_a) * 100 END"""
DAILY_UTILITY = f"sum(resp * weight * {taken('pred')})"
RANKS = f"""{LABELLED}, ranks AS (SELECT row_id, y, count(*) OVER (PARTITION BY y) AS size,
  row_number() OVER (PARTITION BY y ORDER BY md5(row_id || ':42'), row_id) - 1 AS pos FROM labelled)"""

QUERIES = {
    "purged_splits": split_query(),
    "purged_splits_gap": split_query(gap=2),
    "purged_splits_limited": split_query(max_train=8, gap=1),
    "time_series_splits": time_series,
    "stratified_folds": stratified,
    "stratified_folds_by_hash": stratified_hash,
    "stratified_holdout": holdout,
    "trade_actions": lambda spark, sf: ut.actions(ticks(spark, sf), "pred", ["date"]).select(
        "row_id", "action"
    ),
    "utility_by_day": lambda spark, sf: rounded(ut.utility(trades(spark, sf), "pred", R, ["date"])),
    "utility_with_penalty": lambda spark, sf: rounded(
        ut.utility(raw_ticks(spark, sf), "pred", R, ["date"], penalty=0.01)
    ),
    "utility_of_decisions": whole_decisions,
    "utility_improvement": improvement_by_day,
    "risk_adjusted_utility": lambda spark, sf: rounded(
        ut.risk_adjusted_utility(trades(spark, sf), "pred", R)
    ),
    "trading_performance": lambda spark, sf: rounded(
        ut.trading_performance(trades(spark, sf), "pred", R), 3
    ),
    "trading_performance_by_day": lambda spark, sf: rounded(
        ut.trading_performance(raw_ticks(spark, sf), "pred", R, by=["date"])
    ),
    "decision_deciles": lambda spark, sf: rounded(
        ut.decision_deciles(raw_ticks(spark, sf), "pred", R)
    ),
    "auc_by_day": lambda spark, sf: rounded(sc.auc(loose(spark, sf), "pred", "y", ["date"])),
    "auc_tied_scores": lambda spark, sf: rounded(
        sc.auc(
            trades(spark, sf).withColumn("score", F.floor(F.col("pred") * 10)).withColumn("part", F.expr("date div 500")),
            "score",
            "y",
            ["part"],
        )
    ),
    "accuracy": lambda spark, sf: rounded(
        sc.classification_metrics(loose(spark, sf), "pred", "y", ["date"], ("accuracy",))
    ),
    "precision": lambda spark, sf: rounded(
        sc.classification_metrics(loose(spark, sf), "pred", "y", ["date"], ("precision",))
    ),
    "recall": lambda spark, sf: rounded(
        sc.classification_metrics(loose(spark, sf), "pred", "y", ["date"], ("recall",))
    ),
    "fold_report": report,
    "fold_predictions": out_of_fold,
    "fold_aggregates": on_scores(sc.aggregate_folds),
    "comparison_summary": on_scores(lambda s: cmp.comparison_summary(s, METRICS)),
    "paired_ttest": on_scores(lambda s: cmp.paired_ttest(s, "boosted", "blend")),
    "significance_tests": on_scores(lambda s: cmp.significance_tests(s, ["boosted", "blend"])),
    "best_model": on_scores(cmp.best_model),
    "best_model_by_size": on_scores(lambda s: cmp.best_model(s, by_abs=True)),
    "compare_two_models": on_scores(lambda s: cmp.compare(s, "boosted", "blend")),
    "validate_improvement": on_scores(
        lambda s: cmp.validate_improvement(s, "boosted", "blend").drop(
            "baseline_scores", "improved_scores"
        )
    ),
}


def split_sql(max_train: int | None, gap: int) -> str:
    keep = "true" if max_train is None else f"back <= {max_train}"
    return f"""WITH {TICKS_SQL}, {FOLDS_SQL}, placed AS (
      SELECT *, row_number() OVER (PARTITION BY fold, role ORDER BY date DESC) AS back,
        min(CASE WHEN role = 'test' THEN date END) OVER (PARTITION BY fold) AS first_test FROM members)
      SELECT fold, role, row_id, date FROM placed JOIN ticks USING (date)
      WHERE role = 'test' OR ({keep} AND date < first_test - {gap})"""


SQL = {
    "purged_splits": split_sql(None, 0),
    "purged_splits_gap": split_sql(None, 2),
    "purged_splits_limited": split_sql(8, 1),
    "time_series_splits": f"""WITH {TICKS_SQL}, sizes AS (SELECT count(*) AS n, count(*) // 6 AS size FROM ticks)
      SELECT fold::INTEGER AS fold, CASE WHEN row_id < n - (5 - fold) * size THEN 'train' ELSE 'test' END AS role, row_id
      FROM ticks, sizes, (SELECT unnest(range(5)) AS fold) WHERE row_id < n - (4 - fold) * size""",
    "stratified_folds": f"WITH {RANKS} SELECT row_id, y, (pos % 5)::INTEGER AS fold FROM ranks",
    "stratified_folds_by_hash": f"""WITH {LABELLED} SELECT row_id, y,
      (('0x' || substr(md5(row_id || ':42'), 1, 8))::BIGINT % 5)::INTEGER AS fold FROM labelled""",
    "stratified_holdout": f"WITH {RANKS} SELECT row_id, y, pos < floor(size * 0.2 + 0.5) AS is_validation FROM ranks",
    "trade_actions": f"""WITH {TICKS_SQL} SELECT row_id, CASE WHEN bool_or(pred > 0 AND pred < 1)
      OVER (PARTITION BY date) THEN (pred >= 0.5e0)::INTEGER ELSE trunc(pred)::INTEGER END AS action FROM ticks""",
    "utility_by_day": f"WITH {TRADES_SQL}, out AS (SELECT date, {DAILY_UTILITY} AS utility FROM trades GROUP BY date) "
    + round_sql("out", ["date"], ["utility"]),
    "utility_with_penalty": f"""WITH {TICKS_SQL}, out AS (SELECT date, {DAILY_UTILITY}
      - 0.01e0 * sum({taken('pred')}) AS utility FROM ticks GROUP BY date) """
    + round_sql("out", ["date"], ["utility"]),
    "utility_of_decisions": f"""WITH {TRADES_SQL}, out AS (SELECT date,
      sum(resp * weight * floor(pred * 3)) AS utility FROM trades GROUP BY date) """
    + round_sql("out", ["date"], ["utility"]),
    "utility_improvement": f"""WITH {TICKS_SQL}, out AS (SELECT date, coalesce(sum(resp * weight * {taken('pred')}), 0) AS mean_a,
      coalesce(sum(resp * weight * {taken('pred_b')}), 0) AS mean_b FROM ticks GROUP BY date),
      named AS (SELECT date, mean_a AS base, mean_b AS model, {PCT} AS improvement_pct FROM out) """
    + round_sql("named", ["date"], ["base", "model", "improvement_pct"]),
    "risk_adjusted_utility": f"""WITH {TRADES_SQL}, daily AS (SELECT date, {DAILY_UTILITY} AS gain FROM trades GROUP BY date),
      out AS (SELECT sum(gain) / sqrt(var_samp(gain)) AS risk_adjusted_utility FROM daily) """
    + round_sql("out", [], ["risk_adjusted_utility"]),
    "decision_deciles": f"""WITH {TICKS_SQL}, edges AS (SELECT quantile_cont(pred, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS e FROM ticks),
      binned AS (SELECT *, len(list_filter(e, lambda v: v < pred))::INTEGER AS q, (pred >= 0.5e0)::INTEGER AS d FROM ticks, edges),
      out AS (SELECT q AS pred_quantile, count(*) AS prediction_count, round_even(avg(pred), 4) AS prediction_mean,
        round_even(avg(resp), 4) AS actual_return_mean, round_even(stddev_samp(resp), 4) AS actual_return_std,
        round_even(avg(weight), 4) AS weight_mean, round_even(avg(d), 4) AS decision_mean,
        sum(resp * weight * d) AS utility FROM binned GROUP BY q) """
    + round_sql(
        "out",
        ["pred_quantile", "prediction_count"],
        ["prediction_mean", "actual_return_mean", "actual_return_std", "weight_mean", "decision_mean", "utility"],
    ),
    "auc_by_day": f"WITH {LABELLED}, out AS ({auc_sql('labelled', 'date')}) " + round_sql("out", ["date"], ["auc"]),
    "auc_tied_scores": f"""WITH {TRADES_SQL}, scored AS (SELECT date // 500 AS part, y, floor(pred * 10) AS score FROM trades),
      out AS ({auc_sql('scored', 'part', 'score')}) """
    + round_sql("out", ["part"], ["auc"]),
    "fold_report": f"""WITH {TESTED}, m AS (SELECT fold, count(*) AS test_size, {plain_metrics('pred')},
        sum({taken('pred')})::BIGINT AS n_positive_actions, avg(resp) AS mean_return, avg(weight) AS mean_weight
        FROM tested GROUP BY fold), a AS ({auc_sql('tested', 'fold')}),
      s AS (SELECT fold, count(*) AS train_size FROM members JOIN ticks USING (date) WHERE role = 'train' GROUP BY fold),
      out AS (SELECT * FROM m JOIN a USING (fold) JOIN s USING (fold)) """
    + round_sql(
        "out",
        ["fold", "train_size", "test_size", "n_positive_actions"],
        ["utility", "auc", "accuracy", '"precision"', "recall", "mean_return", "mean_weight"],
    ),
    "fold_predictions": f"""WITH {TESTED}, out AS (SELECT fold, row_id, y AS y_true, pred AS y_pred_proba,
      (pred >= 0.5e0)::INTEGER AS y_pred_binary FROM tested) """
    + round_sql("out", ["fold", "row_id", "y_true", "y_pred_binary"], ["y_pred_proba"]),
    "fold_aggregates": f"""{SCORES}, out AS (SELECT model, metric, avg(score) AS mean_score,
      stddev_pop(score) AS std_score FROM scores GROUP BY model, metric) """
    + round_sql("out", ["model", "metric"], ["mean_score", "std_score"]),
    "comparison_summary": f"{SCORES}, out AS (SELECT model, "
    + ", ".join(
        f"avg(CASE WHEN metric = '{m}' THEN score END) AS \"{m}\", "
        f"stddev_pop(CASE WHEN metric = '{m}' THEN score END) AS {m}_std"
        for m in METRICS
    )
    + " FROM scores GROUP BY model) "
    + round_sql("out", ["model"], [c for m in METRICS for c in (f'"{m}"', f"{m}_std")]),
    "paired_ttest": f"{PAIRED} SELECT metric, round(t + 1.234e-9, 6) AS t_statistic, round(p + 1.234e-9, 6) AS p_value, "
    "p < 0.05 AS significant_at_05, better AS better_model FROM tested_pairs",
    "significance_tests": f"{PAIRED} SELECT metric, 'boosted' AS first, 'blend' AS second, "
    "round(t + 1.234e-9, 6) AS t_statistic, round(p + 1.234e-9, 6) AS p_value, "
    "p < 0.05 AS significant_at_05, better AS better_model FROM tested_pairs",
    "best_model": f"{PAIRED} SELECT metric, CASE WHEN mean_a > mean_b THEN 'boosted' ELSE 'blend' END AS best_model FROM tests",
    "best_model_by_size": f"""{PAIRED} SELECT metric, CASE WHEN metric = 'utility' AND abs(mean_a) > abs(mean_b)
      OR metric <> 'utility' AND mean_a > mean_b THEN 'boosted' ELSE 'blend' END AS best_model FROM tests""",
    "compare_two_models": f"""{PAIRED}, out AS (SELECT mean_a AS base_mean_utility, mean_b AS model_mean_utility,
      mean_b - mean_a AS absolute_improvement, {PCT} AS improvement_pct, -t AS t_statistic, p AS p_value,
      {PCT} >= 12 AS meets_target, p < 0.05 AS significant_at_05 FROM tested_pairs WHERE metric = 'utility') """
    + round_sql(
        "out",
        ["meets_target", "significant_at_05"],
        ["base_mean_utility", "model_mean_utility", "absolute_improvement", "improvement_pct", "t_statistic", "p_value"],
    ),
    "validate_improvement": f"""{PAIRED}, out AS (SELECT metric, mean_a AS baseline_mean, mean_b AS improved_mean,
      mean_b - mean_a AS absolute_improvement, {PCT} AS improvement_pct, 12e0 AS target_improvement,
      {PCT} >= 12 AS meets_target, t AS t_statistic, p AS p_value, p < 0.05 AS significant_at_05,
      better AS better_model FROM tested_pairs WHERE metric = 'utility') """
    + round_sql(
        "out",
        ["metric", "meets_target", "significant_at_05", "better_model"],
        ["baseline_mean", "improved_mean", "absolute_improvement", "improvement_pct", "target_improvement", "t_statistic", "p_value"],
    ),
}
for metric in ("accuracy", "precision", "recall"):
    SQL[metric] = (
        f"WITH {LABELLED}, out AS (SELECT date, {plain_metrics('pred')} FROM labelled GROUP BY date) "
        + round_sql("out", ["date"], [f'"{metric}"'])
    )


def _performance(source: str, by: str) -> str:
    keys = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"""SELECT {keys}coalesce(sum(value * a), 0) AS gross_utility,
      sum(a) * 0.001e0 * coalesce(sum(abs(value)), 0) AS transaction_costs,
      coalesce(sum(value * a), 0) - sum(a) * 0.001e0 * coalesce(sum(abs(value)), 0) AS net_utility,
      sum(a)::BIGINT AS n_trades, sum(a) / count(*)::DOUBLE AS trade_rate,
      CASE WHEN sum(a) > 0 THEN avg(CASE WHEN a = 1 THEN value END) ELSE 0e0 END AS avg_return_per_trade,
      CASE WHEN sum(a) > 0 THEN avg(coalesce(resp * a > 0, false)::INTEGER) ELSE 0e0 END AS hit_rate
    FROM (SELECT *, resp * weight AS value, {taken('pred')} AS a FROM {source}){group}"""


PERFORMANCE = ["gross_utility", "transaction_costs", "net_utility", "trade_rate", "avg_return_per_trade", "hit_rate"]
SQL["trading_performance"] = (
    f"WITH {TRADES_SQL}, out AS ({_performance('trades', '')}) " + round_sql("out", ["n_trades"], PERFORMANCE, 3)
)
SQL["trading_performance_by_day"] = (
    f"WITH {TICKS_SQL}, out AS ({_performance('ticks', 'date')}) "
    + round_sql("out", ["date", "n_trades"], PERFORMANCE)
)
