"""Row-ordered indicators over the tick view."""

from __future__ import annotations

from checks.views import CELLS_SQL, TICKS_SQL, round_sql, rounded, ticks
from quantloom import Roles
from quantloom.operators import indicators as ind

R = Roles()


def frame(w: int) -> str:
    return f"(PARTITION BY feature ORDER BY row_id ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


ORDER = "(PARTITION BY feature ORDER BY row_id)"


def whole(expr: str, w: int, x: str = "x") -> str:
    return f"CASE WHEN count({x}) OVER {frame(w)} = {w} THEN {expr} OVER {frame(w)} END"


def std(w: int, x: str = "x") -> str:
    return (
        f"CASE WHEN count({x}) OVER {frame(w)} = {w} THEN CASE WHEN min({x}) OVER {frame(w)} = "
        f"max({x}) OVER {frame(w)} THEN 0e0 ELSE stddev_samp({x}) OVER {frame(w)} END END"
    )


def lag(k: int, x: str = "x") -> str:
    return f"lag({x}, {k}) OVER {ORDER}"


def query(columns: dict[str, str], source: str = "cells", extra: str = "", digits: int | None = 6) -> str:
    body = ", ".join(f"{sql} AS {name}" for name, sql in columns.items())
    return (
        f"WITH {CELLS_SQL}{extra}, out AS (SELECT row_id, feature, {body} FROM {source}) "
        + round_sql("out", ["row_id", "feature"], list(columns), digits)
    )


def over(fn, digits=6, **kw):
    return lambda spark, sf: rounded(fn(ticks(spark, sf), R, **kw), digits)


LOOK, QUANT = ind.LOOKBACKS, ind.QUANTILE_WINDOWS
FILLED = (
    f", filled AS (SELECT *, last_value(x IGNORE NULLS) OVER (PARTITION BY feature ORDER BY row_id "
    f"ROWS UNBOUNDED PRECEDING) AS xf FROM cells), moves AS (SELECT *, "
    f"xf / nullif({lag(1, 'xf')}, 0) - 1 AS ret FROM filled)"
)


def quantile_query(parts: dict[str, str], digits: int | None = 6) -> str:
    qs = ", ".join(
        f"{whole(f'quantile_cont(x, {q})', w)} AS {n}_{w}"
        for w in QUANT
        for n, q in (("q25", 0.25), ("q75", 0.75))
    )
    extra = f", qs AS (SELECT row_id, feature, x, {qs} FROM cells)"
    cols = {f"{n}_{w}": sql.format(w=w) for w in QUANT for n, sql in parts.items()}
    return query(cols, "qs", extra, digits)


QUERIES = {
    "row_index": lambda spark, sf: ticks(spark, sf).select("row_id", "event_id"),
    "lag_features": over(ind.lag_features),
    "rolling_mean": over(ind.rolling_stats, stats=("mean",)),
    "rolling_std": over(ind.rolling_stats, stats=("std",)),
    "rolling_min": over(ind.rolling_stats, stats=("min",)),
    "rolling_max": over(ind.rolling_stats, stats=("max",)),
    "rolling_zscore": over(ind.rolling_stats, stats=("zscore",)),
    "rolling_pct_from_mean": over(ind.rolling_stats, stats=("pct_from_mean",)),
    "simple_returns": over(ind.momentum, windows=(), roc=(), trend=()),
    "simple_returns_unfilled": over(ind.momentum, windows=(), roc=(), trend=(), fill=None),
    "momentum": over(ind.momentum, returns=(), roc=(), trend=()),
    "rate_of_change": over(ind.momentum, returns=(), windows=(), trend=()),
    "trend_slope": over(ind.momentum, returns=(), windows=(), roc=()),
    "return_volatility": over(ind.volatility, measures=("volatility",)),
    "average_range": over(ind.volatility, measures=("atr",)),
    "coefficient_of_variation": over(ind.volatility, measures=("cv",)),
    "rolling_quartiles": over(ind.rolling_quantiles, outputs=("q25", "q75")),
    "rolling_iqr": over(ind.rolling_quantiles, outputs=("iqr",)),
    "quartile_flags": over(ind.rolling_quantiles, outputs=("above_q75", "below_q25")),
}

SQL = {
    "row_index": f"WITH {TICKS_SQL} SELECT row_id, event_id FROM ticks",
    "lag_features": query({f"lag_{k}": lag(k) for k in ind.LAGS}),
    "rolling_mean": query({f"mean_{w}": whole("avg(x)", w) for w in LOOK}),
    "rolling_std": query({f"std_{w}": std(w) for w in LOOK}),
    "rolling_min": query({f"min_{w}": whole("min(x)", w) for w in LOOK}),
    "rolling_max": query({f"max_{w}": whole("max(x)", w) for w in LOOK}),
    "rolling_zscore": query(
        {f"zscore_{w}": f"(x - ({whole('avg(x)', w)})) / nullif({std(w)}, 0)" for w in LOOK}
    ),
    "rolling_pct_from_mean": query(
        {f"pct_from_mean_{w}": f"x / nullif({whole('avg(x)', w)}, 0) - 1" for w in LOOK}
    ),
    "simple_returns": query(
        {f"return_{w}": f"xf / nullif({lag(w, 'xf')}, 0) - 1" for w in ind.RETURNS}, "filled", FILLED
    ),
    "simple_returns_unfilled": query(
        {f"return_{w}": f"x / nullif({lag(w)}, 0) - 1" for w in ind.RETURNS}
    ),
    "momentum": query({f"momentum_{w}": f"x / nullif({lag(w)}, 0) - 1" for w in LOOK}),
    "rate_of_change": query({f"roc_{w}": f"(x - {lag(w)}) / nullif({lag(w)}, 0)" for w in ind.ROC}),
    "trend_slope": query(
        {f"trend_{w}": whole("regr_slope(x, row_id)", w) for w in ind.TREND}
    ),
    "return_volatility": query({f"volatility_{w}": std(w, "ret") for w in LOOK}, "moves", FILLED),
    "average_range": query(
        {
            f"atr_{w}": f"({whole('max(x)', w)} - ({whole('min(x)', w)})) / nullif({whole('avg(x)', w)}, 0)"
            for w in LOOK
        }
    ),
    "coefficient_of_variation": query(
        {f"cv_{w}": f"({std(w)}) / nullif({whole('avg(x)', w)}, 0)" for w in LOOK}
    ),
    "rolling_quartiles": quantile_query({"q25": "q25_{w}", "q75": "q75_{w}"}),
    "rolling_iqr": quantile_query({"iqr": "q75_{w} - q25_{w}"}),
    "quartile_flags": quantile_query(
        {
            "above_q75": "coalesce(x > q75_{w}, false)::INTEGER",
            "below_q25": "coalesce(x < q25_{w}, false)::INTEGER",
        },
        digits=None,
    ),
}
