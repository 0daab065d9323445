"""Indicators against pandas on hand-made edge cases."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest

from quantloom import Roles
from quantloom.operators import indicators as ind
from quantloom.operators.crosssection import CROSS_SECTION, cross_section, interactions
from quantloom.operators.featureset import all_features, feature_names, feature_summary, unpack_features
from quantloom.operators.indicators import ALL_INDICATORS, IndicatorSet, indicator_rows

R = Roles()


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(7)
    n = 400
    x = rng.normal(10, 3, n).round(2)
    x[60:95] = 4.0  # constant windows
    y = rng.normal(0, 2, n).round(1)
    y[rng.random(n) < 0.1] = 0.0
    y[rng.random(n) < 0.02] = np.nan
    y[200:204] = np.nan
    z = rng.integers(0, 4, n).astype(float)
    z[5] = np.inf
    return pd.DataFrame({"row_id": np.arange(n), "feature_0": x, "feature_1": y, "feature_2": z})


def expected(x: pd.Series) -> pd.DataFrame:
    x = x.replace([np.inf, -np.inf], np.nan)
    out = {}
    for k in (1, 2, 3):
        out[f"lag_{k}"] = x.shift(k)
    filled = x.ffill()
    moves = (filled / filled.shift(1) - 1).replace([np.inf, -np.inf], np.nan)
    for w in (5, 10, 20):
        roll = x.rolling(w)
        flat = roll.max() == roll.min()
        std = roll.std().mask(flat, 0.0)
        mean = roll.mean()
        out[f"mean_{w}"], out[f"std_{w}"] = mean, std
        out[f"min_{w}"], out[f"max_{w}"] = roll.min(), roll.max()
        out[f"zscore_{w}"] = (x - mean) / std.replace(0, np.nan)
        out[f"pct_from_mean_{w}"] = x / mean - 1
        out[f"momentum_{w}"] = x / x.shift(w) - 1
        spread = moves.rolling(w)
        out[f"volatility_{w}"] = spread.std().mask(spread.max() == spread.min(), 0.0)
        out[f"atr_{w}"] = (roll.max() - roll.min()) / mean
        out[f"cv_{w}"] = std / mean
    for w in (1, 2, 5, 10):
        out[f"return_{w}"] = filled / filled.shift(w) - 1
    for w in (3, 7, 14):
        out[f"roc_{w}"] = (x - x.shift(w)) / x.shift(w)
    for w in (10, 20):
        at = np.arange(w)
        out[f"trend_{w}"] = x.rolling(w).apply(lambda v: np.polyfit(at, v, 1)[0], raw=True)
    for w in (50, 100):
        q25, q75 = x.rolling(w).quantile(0.25), x.rolling(w).quantile(0.75)
        out[f"q25_{w}"], out[f"q75_{w}"], out[f"iqr_{w}"] = q25, q75, q75 - q25
        out[f"above_q75_{w}"] = (x > q75).astype(int)
        out[f"below_q25_{w}"] = (x < q25).astype(int)
    return pd.DataFrame(out).replace([np.inf, -np.inf], np.nan)


@pytest.mark.parametrize("block_rows", [None, 128])
def test_every_family_matches_pandas(spark, table, block_rows):
    rows = ind.indicator_rows(spark.createDataFrame(table), R, ind.ALL_INDICATORS, block_rows=block_rows)
    got = rows.toPandas()
    for i in range(3):
        mine = got[got["f"] == i].sort_values("row_id")
        want = expected(table[f"feature_{i}"])
        assert len(mine) == len(table)
        for name in want:
            a, b = mine[name].to_numpy(float), want[name].to_numpy(float)
            if name.startswith(("pct_from_mean", "atr", "cv")):
                # A mean that is 0 but for rounding has no meaningful ratio.
                b = np.where(np.abs(want[f"mean_{name.rsplit('_', 1)[1]}"]) < 1e-9, a, b)
            np.testing.assert_allclose(a, b, rtol=1e-7, atol=1e-8, equal_nan=True, err_msg=name)


def test_short_table_gives_no_full_window(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0)], "row_id long, feature_0 double")
    rows = ind.rolling_stats(df, R).collect()
    assert all(row["mean_5"] is None for row in rows)
    flags = ind.rolling_quantiles(df, R).collect()
    assert all(row["above_q75_50"] == 0 for row in flags)


def test_cross_section_matches_pandas(spark):
    nan = np.nan
    x = pd.DataFrame(
        [
            [1.0, 2.0, 2.0, -4.0, 9.5],
            [3.0, 3.0, 3.0, 3.0, 3.0],
            [1.0, nan, 7.0, nan, nan],
            [nan] * 5,
            [5.0, nan, nan, nan, nan],
            [0.0, -1.0, 2.0, 2.0, nan],
        ],
        columns=[f"feature_{i}" for i in range(5)],
    )
    got = (
        cross_section(spark.createDataFrame(x.assign(row_id=range(len(x)))), R)
        .orderBy("row_id")
        .toPandas()
    )
    pct = x.rank(axis=1, pct=True)
    want = pd.DataFrame(
        {
            "rank_mean": pct.mean(axis=1),
            "rank_std": pct.std(axis=1),
            "feature_mean": x.mean(axis=1),
            "feature_std": x.std(axis=1),
            "feature_median": x.median(axis=1),
            "feature_skew": x.skew(axis=1),
            "feature_kurt": x.kurtosis(axis=1),
            "n_positive": (x > 0).sum(axis=1),
            "n_negative": (x < 0).sum(axis=1),
            "n_extreme_positive": (x.gt(x.quantile(0.95, axis=1), axis=0)).sum(axis=1),
            "n_extreme_negative": (x.lt(x.quantile(0.05, axis=1), axis=0)).sum(axis=1),
        }
    )
    for c in CROSS_SECTION:
        np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), atol=1e-9, equal_nan=True, err_msg=c)


def test_interactions_alternate_and_stop_at_the_limit(spark):
    df = spark.createDataFrame([(0, 6.0, 3.0, 0.0)], "row_id long, feature_0 double, feature_1 double, feature_2 double")
    row = interactions(df, R, limit=5).first()
    assert list(row.asDict()) == [
        "row_id", "feature_0_feature_1_mult", "feature_0_feature_1_div",
        "feature_0_feature_2_mult", "feature_0_feature_2_div", "feature_1_feature_2_mult",
    ]
    assert row["feature_0_feature_1_div"] == 2.0 and row["feature_0_feature_2_div"] is None


def test_all_features_are_named_in_family_order(spark, table):
    made = all_features(spark.createDataFrame(table), R)
    names = feature_names(made)
    counts = {r["family"]: r["columns"] for r in feature_summary(spark.createDataFrame(table), R).collect()}
    assert len(names) == sum(counts.values()) == len(set(names))
    assert names[:4] == ["feature_0", "feature_1", "feature_2", "feature_0_lag_1"]
    wide = unpack_features(made, ["row_id"]).orderBy("row_id").toPandas()
    np.testing.assert_allclose(
        wide["feature_1_mean_10"].to_numpy(float), expected(table["feature_1"])["mean_10"].to_numpy(), atol=1e-9, equal_nan=True
    )


def test_default_width_of_130_features(spark):
    df = spark.createDataFrame([], "row_id long, " + ", ".join(f"feature_{i} double" for i in range(130)))
    assert feature_summary(df, R).groupBy().sum("columns").first()[0] == 6951


@pytest.mark.parametrize("step,fill", [(1, "pad"), (3, "pad"), (1, None)])
def test_arrays_hold_what_the_rows_hold(spark, monkeypatch, step, fill):
    """Every family from streamed blocks, with gaps, constant runs and blocks of few rows, to the last bit of Spark's windows."""
    monkeypatch.setattr(ind, "_CHUNK", 7_000)  # several chunks in a block
    rng = np.random.default_rng(21)
    n = 1400
    x = np.column_stack([rng.normal(size=n).round(1), rng.integers(-2, 3, n), rng.normal(size=n) * 1e-3])
    x[300:380, 0] = x[500:1100, 1] = np.nan  # a gap longer than a block
    x[rng.random((n, 3)) < 0.03] = np.nan
    x[900:940, 2] = 0.3
    pdf = pd.DataFrame(x, columns=[f"feature_{i}" for i in range(3)]).assign(row_id=np.arange(n) * step, tag="a")
    df = spark.createDataFrame(pdf)
    wanted = replace(ALL_INDICATORS, quantile_windows=(20,), fill=fill)
    made = all_features(df, R, wanted, ["tag"], block_rows=256)
    names = feature_names(made)
    got = {r["row_id"]: r["features"] for r in made.select("row_id", "features").collect()}
    assert "slope" not in made.select("features")._jdf.queryExecution().optimizedPlan().toString()
    outputs = wanted.names()
    seen = 0
    for row in indicator_rows(df, R, wanted, block_rows=256).collect():
        values = dict(zip(names, got[row["row_id"]]))
        for o in outputs:
            want, have = row[o], values[f"feature_{row['f']}_{o}"]
            want = None if want is None or not np.isfinite(want) else float(want)
            assert have == want or (have is not None and want is not None and np.isclose(have, want, rtol=1e-12, atol=0)), (row, o, have)
            seen += 1
    assert seen == n * 3 * len(outputs) and len(got) == n


def test_features_of_repeated_row_ids(spark):
    """Rows that share an id stay rows of their own, each with all features."""
    df = spark.createDataFrame([(i // 2, float(i), float(-i)) for i in range(40)], "row_id long, feature_0 double, feature_1 double")
    made = all_features(df, R, IndicatorSet(lags=(1,), windows=(3,)))
    rows = made.collect()
    assert len(rows) == 40 and {len(r["features"]) for r in rows} == {len(feature_names(made))}
    assert sorted(r["row_id"] for r in rows) == sorted([*range(20)] * 2)
