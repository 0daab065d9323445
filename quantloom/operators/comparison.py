"""Model comparison from fold scores ``(model, fold, metric, score)``.

These tables have one row per model, fold and metric, so their size does not depend on the
data; the work on the data was done by ``scoring``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.stats import student_p
from quantloom.operators.scoring import aggregate_folds
from quantloom.operators.utility import improvement


def comparison_summary(scores: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row per model with ``{metric}`` and ``{metric}_std``."""
    wide = scores.groupBy("model").pivot("metric", list(metrics)).agg(
        F.avg("score").alias("mean"), F.stddev_pop("score").alias("std")
    )
    columns = [c for m in metrics for c in (F.col(f"{m}_mean").alias(m), F.col(f"{m}_std"))]
    return wide.select("model", *columns)


def _test_columns(first: Column, second: Column) -> list[Column]:
    """t statistic, p-value and flag of the paired differences ``first - second``."""
    gap, n = F.avg(first - second), F.count(first - second)
    spread = F.stddev_samp(first - second) / F.sqrt(n)
    infinite = F.signum(gap) * float("inf")
    t = F.when(spread == 0, F.when(gap != 0, infinite)).otherwise(gap / spread)
    return [t.alias("t_statistic"), (n - 1).alias("freedom")]


def _paired(scores: DataFrame, first: str, second: str) -> DataFrame:
    a = scores.where(F.col("model") == first).select("metric", "fold", F.col("score").alias("a"))
    b = scores.where(F.col("model") == second).select("metric", "fold", F.col("score").alias("b"))
    return a.join(b, ["metric", "fold"])


def _tested(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    tested = pairs.groupBy(*keys).agg(
        F.count("*").alias("folds"),
        *_test_columns(a, b),
        (F.avg(a) > F.avg(b)).alias("first_wins"),
    )
    # A single fold has no variance to test.
    tested = tested.where("folds > 1").withColumn(
        "p_value", student_p(F.col("t_statistic"), F.col("freedom"))
    )
    return tested.withColumn(
        "significant_at_05", F.coalesce(F.col("p_value") < 0.05, F.lit(False))
    )


def paired_ttest(scores: DataFrame, first: str, second: str, metric: str | None = None) -> DataFrame:
    """Paired t-test of ``first - second`` per metric; the caller chooses the order."""
    if metric is not None:
        scores = scores.where(F.col("metric") == metric)
    better = F.when(F.col("first_wins"), first).otherwise(second)
    return _tested(_paired(scores, first, second), ["metric"]).select(
        "metric", "t_statistic", "p_value", "significant_at_05", better.alias("better_model")
    )


def significance_tests(scores: DataFrame, models: Sequence[str]) -> DataFrame:
    """Paired t-tests of every pair of models, in the order given."""
    pairs = None
    for i, first in enumerate(models):
        for second in models[i + 1 :]:
            one = _paired(scores, first, second).select(
                F.lit(first).alias("first"), F.lit(second).alias("second"), "metric", "fold", "a", "b"
            )
            pairs = one if pairs is None else pairs.unionByName(one)
    better = F.when(F.col("first_wins"), F.col("first")).otherwise(F.col("second"))
    return _tested(pairs, ["metric", "first", "second"]).select(
        "metric", "first", "second", "t_statistic", "p_value", "significant_at_05",
        better.alias("better_model"),
    )


def best_model(scores: DataFrame, by_abs: bool = False) -> DataFrame:
    """Best mean score per metric; ``by_abs`` ranks utility by its absolute value."""
    mean = F.col("mean_score")
    if by_abs:
        mean = F.when(F.col("metric") == "utility", F.abs(mean)).otherwise(mean)
    return aggregate_folds(scores).groupBy("metric").agg(
        F.min_by("model", F.struct((-mean).alias("rank"), "model")).alias("best_model")
    )


def validate_improvement(
    scores: DataFrame, base: str, model: str, target: float = 12.0, metric: str = "utility"
) -> DataFrame:
    """Mean scores, percent improvement against the target, significance and fold scores."""
    pairs = _paired(scores.where(F.col("metric") == metric), base, model)
    test = paired_ttest(scores, base, model, metric)

    def listed(c: str) -> Column:
        ordered = F.array_sort(F.collect_list(F.struct("fold", c)))
        return F.transform(ordered, lambda s: s[c])

    means = pairs.groupBy("metric").agg(
        F.avg("a").alias("baseline_mean"),
        F.avg("b").alias("improved_mean"),
        listed("a").alias("baseline_scores"),
        listed("b").alias("improved_scores"),
    )
    pct = improvement(F.col("baseline_mean"), F.col("improved_mean"))
    return means.join(test, "metric", "left").select(
        "metric",
        "baseline_mean",
        "improved_mean",
        (F.col("improved_mean") - F.col("baseline_mean")).alias("absolute_improvement"),
        pct.alias("improvement_pct"),
        F.lit(float(target)).alias("target_improvement"),
        (pct >= target).alias("meets_target"),
        "t_statistic",
        "p_value",
        "significant_at_05",
        "better_model",
        "baseline_scores",
        "improved_scores",
    )


def compare(scores: DataFrame, base: str, model: str, target: float = 12.0) -> DataFrame:
    """Two models on utility, tested as ``model - base``: the opposite order of the above."""
    test = paired_ttest(scores, model, base, "utility").select(
        "metric", "t_statistic", "p_value", "significant_at_05"
    )
    means = _paired(scores.where("metric = 'utility'"), base, model).groupBy("metric").agg(
        F.avg("a").alias("base_mean_utility"), F.avg("b").alias("model_mean_utility")
    )
    pct = improvement(F.col("base_mean_utility"), F.col("model_mean_utility"))
    return means.join(test, "metric", "left").select(
        "base_mean_utility",
        "model_mean_utility",
        (F.col("model_mean_utility") - F.col("base_mean_utility")).alias("absolute_improvement"),
        pct.alias("improvement_pct"),
        (pct >= target).alias("meets_target"),
        "t_statistic",
        "p_value",
        "significant_at_05",
    )
