"""Weighted-return utility and trading statistics of predictions.

Everything is an aggregate with map-side combine; groups may have any size.
Missing returns or weights are skipped in sums, as SQL aggregates do;
``propagate_missing`` makes a utility with any missing input NULL instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions import ratio
from quantloom.functions.joins import null_safe_join
from quantloom.operators.quantiles import exact_quantiles
from quantloom.roles import Roles


def _taken(pred: Column, threshold: float) -> Column:
    return F.coalesce(pred >= threshold, F.lit(False)).cast("long")


def _whole_number(pred: Column) -> Column:
    return F.coalesce(pred, F.lit(0.0)).cast("long")


def _is_probability(pred: Column) -> Column:
    return F.coalesce(F.bool_or((pred > 0) & (pred < 1)), F.lit(False))


def actions(df: DataFrame, pred: str, by: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """Add ``action``: scores of a group with any value inside (0, 1) are cut at the threshold,
    other scores are already decisions and are truncated to whole numbers."""
    p = F.col(pred)
    kinds = df.groupBy(*by).agg(_is_probability(p).alias("_scores"))
    # Without `by` this is one row; with it Spark picks the join from the measured size.
    joined = null_safe_join(df, kinds, list(by)) if by else df.join(F.broadcast(kinds))
    action = F.when(F.col("_scores"), _taken(p, threshold)).otherwise(_whole_number(p))
    return joined.select(*df.columns, action.cast("int").alias("action"))


def utility_columns(
    pred: Column,
    r: Roles,
    threshold: float = 0.5,
    penalty: float = 0.0,
    convert: bool = True,
    propagate_missing: bool = False,
) -> Column:
    """Utility as one aggregate expression, for ``groupBy(...).agg``.

    Both readings of the scores are summed in the same pass and the right one is picked.
    """
    value = F.col(r.target) * F.col(r.weight)

    def gain(action: Column) -> Column:
        earned = F.coalesce(F.sum(value * action), F.lit(0.0))
        return earned - penalty * F.sum(action) if penalty > 0 else earned

    decided = gain(_whole_number(pred))
    result = (
        F.when(_is_probability(pred), gain(_taken(pred, threshold))).otherwise(decided)
        if convert
        else decided
    )
    if propagate_missing:
        result = F.when(F.count_if(value.isNull()) == 0, result)
    return result


def utility(df: DataFrame, pred: str, r: Roles, by: Sequence[str] = (), **options) -> DataFrame:
    """``(*by, utility)``: sum of return x weight x action, less ``penalty`` per trade."""
    return df.groupBy(*by).agg(utility_columns(F.col(pred), r, **options).alias("utility"))


def improvement(base: Column, model: Column) -> Column:
    """Percent improvement over ``base``; over 0 it is 100 for a gain, else 0."""
    return F.when(base == 0, F.when(model > 0, 100.0).otherwise(0.0)).otherwise(
        ratio(model - base, F.abs(base)) * 100
    )


def risk_adjusted_utility(
    df: DataFrame, pred: str, r: Roles, by: Sequence[str] = (), threshold: float = 0.5
) -> DataFrame:
    """Total of the daily gains over the square root of their variance."""
    daily = df.groupBy(*by, r.date).agg(
        utility_columns(F.col(pred), r, threshold).alias("gain")
    )
    return daily.groupBy(*by).agg(
        ratio(F.sum("gain"), F.sqrt(F.var_samp("gain"))).alias("risk_adjusted_utility")
    )


def trading_performance(
    df: DataFrame, pred: str, r: Roles, cost: float = 0.001, threshold: float = 0.5, by: Sequence[str] = ()
) -> DataFrame:
    """Gross and net utility, cost, number and rate of trades, average gain and hit rate."""
    action = _taken(F.col(pred), threshold)
    value = F.col(r.target) * F.col(r.weight)
    hit = F.coalesce(F.col(r.target) * action > 0, F.lit(False)).cast("int")
    sums = df.groupBy(*by).agg(
        F.coalesce(F.sum(value * action), F.lit(0.0)).alias("gross_utility"),
        F.sum(action).alias("n_trades"),
        F.count("*").alias("rows"),
        F.sum(F.abs(value)).alias("volume"),
        F.avg(F.when(action == 1, value)).alias("per_trade"),
        F.avg(hit).alias("hits"),
    )
    costs = F.col("n_trades") * F.lit(cost) * F.coalesce("volume", F.lit(0.0))
    traded = F.col("n_trades") > 0
    return sums.select(
        *by,
        "gross_utility",
        costs.alias("transaction_costs"),
        (F.col("gross_utility") - costs).alias("net_utility"),
        "n_trades",
        ratio(F.col("n_trades").cast("double"), F.col("rows").cast("double")).alias("trade_rate"),
        F.when(traded, F.col("per_trade")).otherwise(0.0).alias("avg_return_per_trade"),
        F.when(traded, F.col("hits")).otherwise(0.0).alias("hit_rate"),
    )


def decision_deciles(df: DataFrame, pred: str, r: Roles, threshold: float = 0.5) -> DataFrame:
    """Predictions, returns, weights and decisions per decile of the prediction.

    Deciles are right-closed with exact interpolated edges; equal edges are an error.
    """
    qs = [i / 10 for i in range(11)]
    found = exact_quantiles(df, pred, qs).collect()  # eleven rows
    edges = [row["value"] for row in sorted(found, key=lambda row: row["q"])]
    if len(set(edges)) < len(edges):
        raise ValueError("Bin edges must be unique")
    p = F.col(pred)
    decile = sum(((p > edge).cast("int") for edge in edges[2:-1]), (p > edges[1]).cast("int"))
    decision = _taken(p, threshold)
    stats = (
        df.where(p.isNotNull())
        .groupBy(decile.alias("pred_quantile"))
        .agg(
            F.bround(F.avg(p), 4).alias("prediction_mean"),
            F.count(p).alias("prediction_count"),
            F.bround(F.avg(r.target), 4).alias("actual_return_mean"),
            F.bround(F.stddev_samp(r.target), 4).alias("actual_return_std"),
            F.bround(F.avg(r.weight), 4).alias("weight_mean"),
            F.bround(F.avg(decision), 4).alias("decision_mean"),
            F.sum(F.col(r.target) * F.col(r.weight) * decision).alias("utility"),
        )
    )
    every = df.sparkSession.range(10).select(F.col("id").cast("int").alias("pred_quantile"))
    return every.join(stats, "pred_quantile", "left").fillna({"utility": 0.0, "prediction_count": 0})
