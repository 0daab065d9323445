"""Classification metrics and per-fold reports; all folds and models in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions import ratio
from quantloom.functions.joins import null_safe_join
from quantloom.operators.ordering import running_total
from quantloom.operators.splits import Fold, assign
from quantloom.operators.utility import utility_columns
from quantloom.roles import Roles

METRICS = ("utility", "auc", "accuracy", "precision", "recall")


def auc(df: DataFrame, pred: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, auc)`` with ties counted half; 0.5 where only one class is present.

    Rows are first reduced to one per score, so a score shared by very many rows is one
    row; the running count of negatives is then a distributed prefix sum over the scores.
    """
    by = list(by)
    scores = (
        df.where(F.col(pred).isNotNull() & F.col(y).isNotNull())
        .groupBy(*by, F.col(pred).alias("_score"))
        .agg(
            F.count_if(F.col(y) == 1).alias("_positives"),
            F.count_if(F.col(y) != 1).alias("_negatives"),
        )
    )
    ranked = running_total(scores, by, "_score", "_negatives", "_below")
    won = F.sum(F.col("_positives") * (F.col("_below") + F.col("_negatives") / 2))
    pairs = F.sum("_positives").cast("double") * F.sum("_negatives")
    return ranked.groupBy(*by).agg(F.coalesce(ratio(won, pairs), F.lit(0.5)).alias("auc"))


def predicted(pred: Column, threshold: float = 0.5, inclusive: bool = True) -> Column:
    """Predicted class; cross-validation includes the threshold, ``predict`` does not."""
    over = pred >= threshold if inclusive else pred > threshold
    return F.coalesce(over, F.lit(False)).cast("int")


def metric_columns(pred: str, y: str, threshold: float = 0.5, inclusive: bool = True) -> dict[str, Column]:
    """Accuracy, precision and recall as aggregate expressions."""
    guess, truth = predicted(F.col(pred), threshold, inclusive), F.col(y)
    hits = F.count_if((guess == 1) & (truth == 1)).cast("double")
    return {
        "accuracy": F.avg((guess == truth).cast("int")),
        "precision": F.coalesce(ratio(hits, F.sum(guess).cast("double")), F.lit(0.0)),
        "recall": F.coalesce(ratio(hits, F.count_if(truth == 1).cast("double")), F.lit(0.0)),
    }


def classification_metrics(
    df: DataFrame,
    pred: str,
    y: str,
    by: Sequence[str] = (),
    metrics: Sequence[str] = ("auc", "accuracy", "precision", "recall"),
    threshold: float = 0.5,
    inclusive: bool = True,
) -> DataFrame:
    """``(*by, *metrics)``."""
    made = metric_columns(pred, y, threshold, inclusive)
    plain = [c.alias(n) for n, c in made.items() if n in metrics]
    if "auc" not in metrics:
        return df.groupBy(*by).agg(*plain)
    scored = auc(df, pred, y, by)
    if not plain:
        return scored
    counts = df.groupBy(*by).agg(*plain)
    joined = null_safe_join(counts, scored, list(by)) if by else counts.join(F.broadcast(scored))
    return joined.select(*by, *metrics)


def fold_report(
    df: DataFrame,
    folds: Sequence[Fold],
    pred: str,
    y: str,
    r: Roles,
    metrics: Sequence[str] = METRICS,
    threshold: float = 0.5,
) -> DataFrame:
    """One row per fold: train and test size, metrics, trades, mean return and weight."""
    tested = assign(df, folds, ("test",))
    return report_predictions(tested, train_sizes(df, folds), pred, y, r, metrics, threshold)


def train_sizes(df: DataFrame, folds: Sequence[Fold]) -> DataFrame:
    """``(fold, train_size)`` of all folds in one pass without copying rows."""
    counts = df.agg(*[F.count_if(f.train).alias(str(f.number)) for f in folds])
    sizes = counts.unpivot([], counts.columns, "fold", "train_size")
    return sizes.withColumn("fold", F.col("fold").cast("int"))


def report_predictions(
    tested: DataFrame,
    sizes: DataFrame,
    pred: str,
    y: str,
    r: Roles,
    metrics: Sequence[str] = METRICS,
    threshold: float = 0.5,
) -> DataFrame:
    """A fold report from test rows that carry their ``fold``."""
    made = metric_columns(pred, y, threshold)
    made["utility"] = utility_columns(F.col(pred), r, threshold)
    report = tested.groupBy("fold").agg(
        F.count("*").alias("test_size"),
        *[c.alias(n) for n, c in made.items() if n in metrics],
        F.sum(predicted(F.col(pred), threshold)).alias("n_positive_actions"),
        F.avg(r.target).alias("mean_return"),
        F.avg(r.weight).alias("mean_weight"),
    )
    report = sizes.join(report, "fold")
    if "auc" in metrics:
        report = report.join(auc(tested, pred, y, ["fold"]), "fold")
    return report.select(
        "fold", "train_size", "test_size", *metrics, "n_positive_actions", "mean_return", "mean_weight"
    )


def fold_predictions(
    df: DataFrame, folds: Sequence[Fold], pred: str, y: str, row_id: str = "row_id"
) -> DataFrame:
    """Out-of-fold rows: ``(fold, row_id, y_true, y_pred_proba, y_pred_binary)``."""
    return assign(df, folds, ("test",)).select(
        "fold",
        row_id,
        F.col(y).alias("y_true"),
        F.col(pred).alias("y_pred_proba"),
        predicted(F.col(pred)).alias("y_pred_binary"),
    )


def fold_scores(report: DataFrame, model: str, metrics: Sequence[str]) -> DataFrame:
    """A fold report in long form: ``(model, fold, metric, score)``."""
    long = report.unpivot(["fold"], list(metrics), "metric", "score")
    return long.select(F.lit(model).alias("model"), "fold", "metric", "score")


def aggregate_folds(scores: DataFrame) -> DataFrame:
    """Mean and population deviation of each metric over the folds."""
    return scores.groupBy("model", "metric").agg(
        F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score")
    )
