import math

import numpy as np
import pandas as pd
import pytest

from quantloom.operators import quantiles
from quantloom.operators.quantiles import array_quantiles, exact_quantiles

QS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def _frame(n=20_000, seed=7):
    rng = np.random.default_rng(seed)
    v = rng.standard_t(3, size=n)
    v[::3] = 0.25  # a hot value: a third of all rows
    g = np.where(np.arange(n) % 5 == 0, None, np.arange(n) % 3).astype(object)  # a NULL group
    return pd.DataFrame({"g": g, "v": v})


def _key(x):
    return "null" if x is None or (isinstance(x, float) and math.isnan(x)) else str(int(x))


def _expect(pdf):
    out = {}
    for key, part in pdf.groupby(pdf["g"].map(_key)):
        out[key] = np.quantile(part["v"], QS)
    return out


def _check(got, pdf):
    want = _expect(pdf)
    assert len(got) == len(want) * len(QS)
    for key, vals in want.items():
        mine = got[got["g"].map(_key) == key].sort_values("q")["value"].to_numpy()
        np.testing.assert_allclose(mine, vals, atol=1e-12)


@pytest.mark.parametrize("group_rows", [50, 1_000_000])
def test_brackets_exact_with_hot_value_and_null_group(spark, group_rows):
    pdf = _frame()
    got = exact_quantiles(spark.createDataFrame(pdf), "v", QS, ["g"], group_rows).toPandas()
    _check(got, pdf)


def test_missed_brackets_fall_back_exactly(spark):
    pdf = _frame(5_000)
    # No margin and a coarse sketch: brackets often miss their ranks; the result stays exact.
    got = exact_quantiles(spark.createDataFrame(pdf), "v", QS, ["g"], 40, accuracy=20, margin=0).toPandas()
    _check(got, pdf)


def test_only_bracket_values_are_ranked(spark, monkeypatch):
    stored = {}
    real = quantiles.materialise

    def spy(df, label="table"):
        made = real(df, label)
        if label == "distinct":
            stored["rows"] = made.agg({"c": "sum"}).first()[0]
        return made

    monkeypatch.setattr(quantiles, "materialise", spy)
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"v": rng.normal(size=100_000)})
    got = exact_quantiles(spark.createDataFrame(pdf), "v", [0.5], (), accuracy=10_000).first()["value"]
    assert math.isclose(got, float(np.median(pdf["v"])))
    assert stored["rows"] < 0.01 * len(pdf)  # the bracket, not the values


def test_group_without_values(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0)], "g string, v double")
    got = exact_quantiles(df, "v", [0.5], ["g"]).collect()
    assert [(r["g"], r["value"]) for r in got] == [("b", 1.0)]


@pytest.mark.parametrize("step,reach", [(None, 4), (1, 4), (70, 4), (300, 0)])
def test_quantiles_of_arrays(spark, monkeypatch, step, reach):
    """By position, with gaps, ties, NaN above all, and positions with one or no value."""
    rng = np.random.default_rng(11)
    x = np.column_stack([rng.normal(size=2000), rng.integers(0, 3, 2000), np.full(2000, 7.0), rng.exponential(size=2000)])
    x = np.column_stack([x, np.full((2000, 2), np.nan)])
    x[rng.random(2000) < 0.4, 3] = np.nan
    x[5, 4] = -2.5
    rows = [([None if np.isnan(v) else float(v) for v in r],) for r in x]
    rows = [([float("nan") if i < 50 and j == 0 else v for j, v in enumerate(r[0])],) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "v array<double>").repartition(3)
    got = {(r["f"], r["q"]): r["value"] for r in array_quantiles(df, "v", 6, [0.0, 0.25, 0.5, 0.9], step=step, reach=reach).collect()}
    x[:50, 0] = np.inf  # in place of NaN: no wanted rank lies among them
    assert {f for f, _ in got} == {0, 1, 2, 3, 4}
    for (f, q), value in got.items():
        assert np.isclose(value, np.quantile(x[~np.isnan(x[:, f]), f], q), atol=1e-12), (f, q)


def test_only_bracket_values_of_arrays_are_ranked(spark, monkeypatch):
    stored, real = {}, quantiles.materialise

    def spy(df, label="table"):
        made = real(df, label)
        stored[label] = made
        return made

    monkeypatch.setattr(quantiles, "materialise", spy)
    x = np.random.default_rng(1).normal(size=(100_000, 2))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>")
    got = {r["f"]: r["value"] for r in array_quantiles(df, "v", 2, [0.5]).collect()}
    assert got == pytest.approx(dict(enumerate(np.median(x, axis=0))))
    assert stored["distinct"].agg({"c": "sum"}).first()[0] < 0.01 * x.size
