"""Operators on tables with holes in the row index and with missing keys: nothing is lost or shifted."""

from __future__ import annotations

from checks.evaluation import auc_sql
from checks.timeseries import FILLED, LOOK, lag, std, whole
from checks.views import TICK_FEATURES, TICKS_SQL, round_sql, rounded, ticks
from quantloom import Roles
from quantloom.operators import indicators as ind
from quantloom.operators import scoring as sc
from quantloom.operators import splits as sp
from quantloom.operators import utility as ut
from quantloom.operators.cleaning import drop_zero_weight

R = Roles()


def filtered(spark, sf):
    """Ticks indexed first and filtered then, as a cleaning flow does."""
    return drop_zero_weight(ticks(spark, sf), R)


def gapped(spark, sf):
    """Ticks whose day and label are missing in some rows."""
    return ticks(spark, sf).selectExpr(
        "row_id",
        "CASE WHEN event_id % 17 <> 0 THEN date END AS date",
        "CASE WHEN event_id % 19 <> 0 THEN CAST(resp > 0 AS INT) END AS y",
        "CAST(resp > 0 AS INT) AS hit",
        "pred",
    )


KEPT = f"{TICKS_SQL}, kept AS (SELECT *, row_number() OVER (ORDER BY row_id) AS place FROM ticks WHERE weight IS NULL OR weight <> 0)"
CELLS = (
    KEPT
    + ", cells AS ("
    + " UNION ALL ".join(f"SELECT row_id, place, '{f}' AS feature, {f} AS x FROM kept" for f in TICK_FEATURES)
    + ")"
)
GAPPED = f"""{TICKS_SQL}, gapped AS (SELECT row_id, CASE WHEN event_id % 17 <> 0 THEN date END AS date,
  CASE WHEN event_id % 19 <> 0 THEN (resp > 0)::INTEGER END AS y, (resp > 0)::INTEGER AS hit, pred FROM ticks)"""
RANKED = f"""{GAPPED}, ranks AS (SELECT row_id, y,
  row_number() OVER (PARTITION BY y ORDER BY md5(row_id || ':42'), row_id) - 1 AS pos,
  count(*) OVER (PARTITION BY y) AS size FROM gapped)"""


def over(fn, **kw):
    return lambda spark, sf: rounded(fn(filtered(spark, sf), R, **kw))


def query(columns: dict[str, str], source: str = "cells", extra: str = "") -> str:
    body = ", ".join(f"{sql} AS {name}" for name, sql in columns.items())
    return f"WITH {CELLS}{extra}, out AS (SELECT row_id, feature, {body} FROM {source}) " + round_sql(
        "out", ["row_id", "feature"], list(columns)
    )


def time_series(spark, sf):
    t = filtered(spark, sf)
    return sp.assign(t, sp.time_series_folds(t, "row_id", 5)).select("fold", "role", "row_id")


QUERIES = {
    "lag_features_after_filter": over(ind.lag_features),
    "rolling_mean_after_filter": over(ind.rolling_stats, stats=("mean",)),
    "rolling_std_after_filter": over(ind.rolling_stats, stats=("std",)),
    "simple_returns_after_filter": over(ind.momentum, windows=(), roc=(), trend=()),
    "trend_slope_after_filter": over(ind.momentum, returns=(), windows=(), roc=()),
    "time_series_splits_after_filter": time_series,
    "trade_actions_missing_day": lambda spark, sf: ut.actions(gapped(spark, sf), "pred", ["date"]).select("row_id", "action"),
    "auc_missing_day": lambda spark, sf: rounded(sc.auc(gapped(spark, sf), "pred", "hit", ["date"])),
    "stratified_folds_missing_label": lambda spark, sf: sp.with_stratified_fold(gapped(spark, sf), "y", 5, 42).select(
        "row_id", "y", "fold"
    ),
    "stratified_holdout_missing_label": lambda spark, sf: sp.holdout(gapped(spark, sf), "y", 0.2, 42).select(
        "row_id", "y", "is_validation"
    ),
}

SQL = {
    "lag_features_after_filter": query({f"lag_{k}": lag(k) for k in ind.LAGS}),
    "rolling_mean_after_filter": query({f"mean_{w}": whole("avg(x)", w) for w in LOOK}),
    "rolling_std_after_filter": query({f"std_{w}": std(w) for w in LOOK}),
    "simple_returns_after_filter": query(
        {f"return_{w}": f"xf / nullif({lag(w, 'xf')}, 0) - 1" for w in ind.RETURNS}, "filled", FILLED
    ),
    "trend_slope_after_filter": query({f"trend_{w}": whole("regr_slope(x, place)", w) for w in ind.TREND}),
    "time_series_splits_after_filter": f"""WITH {KEPT}, sizes AS (SELECT count(*) AS n, count(*) // 6 AS size FROM kept)
      SELECT fold::INTEGER AS fold, CASE WHEN place - 1 < n - (5 - fold) * size THEN 'train' ELSE 'test' END AS role, row_id
      FROM kept, sizes, (SELECT unnest(range(5)) AS fold) WHERE place - 1 < n - (4 - fold) * size""",
    "trade_actions_missing_day": f"""WITH {GAPPED} SELECT row_id, CASE WHEN bool_or(pred > 0 AND pred < 1)
      OVER (PARTITION BY date) THEN (pred >= 0.5e0)::INTEGER ELSE trunc(pred)::INTEGER END AS action FROM gapped""",
    "auc_missing_day": f"WITH {GAPPED}, hits AS (SELECT date, hit AS y, pred FROM gapped), out AS ({auc_sql('hits', 'date')}) "
    + round_sql("out", ["date"], ["auc"]),
    "stratified_folds_missing_label": f"WITH {RANKED} SELECT row_id, y, (pos % 5)::INTEGER AS fold FROM ranks",
    "stratified_holdout_missing_label": f"WITH {RANKED} SELECT row_id, y, pos < floor(size * 0.2 + 0.5) AS is_validation FROM ranks",
}
