"""Cross-validation and model comparison on Spark ML estimators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.operators.models import score_column
from quantloom.operators.scoring import METRICS, aggregate_folds, fold_scores, report_predictions, train_sizes
from quantloom.operators.splits import Fold, make_folds
from quantloom.roles import Roles
from quantloom.session import materialise


def out_of_fold(
    estimator: Estimator, df: DataFrame, folds: Sequence[Fold], keep: Sequence[str], parallelism: int = 2
) -> DataFrame:
    """Test-row scores of a model trained per fold: ``(fold, *keep, pred)``, stored.

    Any estimator works whose model adds ``pred``, ``probability`` or ``prediction``. A few
    folds train at a time, each as ordinary Spark jobs.
    """

    def one(fold: Fold) -> DataFrame:
        model = estimator.copy().fit(df.where(fold.train))
        scored = model.transform(df.where(fold.test))
        return scored.select(F.lit(fold.number).alias("fold"), *keep, score_column(scored).alias("pred"))

    run = inheritable_thread_target(df.sparkSession)(one)
    with ThreadPoolExecutor(parallelism) as pool:
        parts = list(pool.map(run, folds))
    return materialise(reduce(DataFrame.unionByName, parts), "scored")


def cross_validate(
    estimator: Estimator,
    df: DataFrame,
    folds: Sequence[Fold],
    r: Roles,
    y: str = "y",
    metrics: Sequence[str] = METRICS,
    parallelism: int = 2,
) -> DataFrame:
    """The fold report of ``estimator``; metrics of all folds come from one aggregation."""
    keep = [r.row_id, r.date, r.weight, r.target, y]
    scored = out_of_fold(estimator, df, folds, keep, parallelism)
    return report_predictions(scored, train_sizes(df, folds), "pred", y, r, metrics)


def cross_validate_by(
    estimator: Estimator,
    df: DataFrame,
    r: Roles,
    strategy: str = "purged_group_ts",
    n: int = 5,
    gap: int = 0,
    seed: int = 42,
    y: str = "y",
    metrics: Sequence[str] = METRICS,
    name: str = "model",
    parallelism: int = 2,
) -> tuple[DataFrame, DataFrame]:
    """Cross-validation with the folds of a named strategy: the fold report, and its aggregates."""
    table, folds = make_folds(df, r, strategy, n, gap, seed, y)
    if table is not df:
        table = materialise(table, "folds")  # every fold reads it
    report = materialise(cross_validate(estimator, table, folds, r, y, metrics, parallelism), "report")
    return report, aggregate_folds(fold_scores(report, name, metrics))


def compare_models(
    models: Mapping[str, Estimator],
    df: DataFrame,
    folds: Sequence[Fold],
    r: Roles,
    y: str = "y",
    metrics: Sequence[str] = ("utility", "auc"),
    parallelism: int = 2,
) -> DataFrame:
    """Fold scores of every model, the input of ``operators.comparison``.

    Store ``df`` before if it is costly: every fold of every model reads it.
    """
    made = [
        fold_scores(cross_validate(m, df, folds, r, y, metrics, parallelism), name, metrics)
        for name, m in models.items()
    ]
    return materialise(reduce(DataFrame.unionByName, made), "scores")
