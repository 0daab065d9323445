"""Holes in the row index, missing keys and reader rules."""

import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from quantloom import Roles
from quantloom.operators import splits as sp
from quantloom.operators.cleaning import validate_structure
from quantloom.operators.featureset import pack_features
from quantloom.operators.indicators import IndicatorSet, indicator_rows
from quantloom.operators.ordering import dense_rows
from quantloom.operators.scoring import auc
from quantloom.operators.selection import correlation_pairs
from quantloom.operators.utility import actions
from quantloom.sources import read_table

R = Roles()


@pytest.fixture(scope="module")
def holes(spark):
    rows = [(i, float((i * 37) % 101)) for i in range(3000) if i % 11 and i % 13 != 4]
    return spark.createDataFrame(rows, "row_id long, feature_0 double"), pd.DataFrame(rows, columns=["row_id", "x"])


@pytest.mark.parametrize("block_rows", [64, 1000, None])
def test_windows_count_rows_whatever_the_block(holes, block_rows):
    df, want = holes
    wanted = IndicatorSet(lags=(3,), windows=(20,), stats=("mean",), returns=(2,), trend=(10,))
    got = indicator_rows(df, R, wanted, block_rows=block_rows).toPandas().sort_values("row_id")
    assert got.row_id.tolist() == want.row_id.tolist()
    x = want.x
    np.testing.assert_allclose(got.lag_3, x.shift(3))
    np.testing.assert_allclose(got.mean_20, x.rolling(20).mean())
    slope = x.rolling(10).apply(lambda w: np.polyfit(np.arange(10), w, 1)[0], raw=True)
    np.testing.assert_allclose(got.trend_10, slope, atol=1e-9)
    before = x.shift(2)
    np.testing.assert_allclose(got.return_2, np.where(before == 0, np.nan, x / before.replace(0, np.nan) - 1))


def test_dense_or_not(spark, holes):
    assert dense_rows(holes[0], "row_id") is None
    assert dense_rows(spark.range(50).toDF("row_id"), "row_id") == 50
    assert dense_rows(spark.range(1, 5).toDF("row_id"), "row_id") is None
    assert dense_rows(spark.createDataFrame([(0,), (1,), (1,), (3,)], "row_id int"), "row_id") is None
    # Same count, least, greatest, sum and sum of squares as 0..7, yet not dense.
    odd = spark.createDataFrame([(v,) for v in [0, 2, 2, 3, 3, 4, 7, 7]], "row_id int")
    assert dense_rows(odd, "row_id") is None
    assert dense_rows(spark.createDataFrame([(v,) for v in [3, 0, 2, 1]], "row_id int"), "row_id") == 4
    assert dense_rows(spark.createDataFrame([(0,), (None,), (1,)], "row_id int"), "row_id") is None
    assert dense_rows(spark.range(0).toDF("row_id"), "row_id") == 0


def test_time_series_folds_are_even(holes):
    df, want = holes
    sizes = sp.assign(df, sp.time_series_folds(df, "row_id", 5)).groupBy("fold", "role").count().collect()
    size = len(want) // 6
    assert {(r.fold, r["count"]) for r in sizes if r.role == "test"} == {(k, size) for k in range(5)}
    assert {(r.fold, r["count"]) for r in sizes if r.role == "train"} == {(k, len(want) - (5 - k) * size) for k in range(5)}


def test_rows_with_missing_keys_stay(spark):
    df = spark.range(400).selectExpr("id AS row_id", "CASE WHEN id % 5 <> 0 THEN id % 7 END AS date", "CASE WHEN id % 3 <> 0 THEN CAST(id % 2 AS INT) END AS y", "(id % 10) / 10.0D AS pred", "CAST(id % 2 AS INT) AS hit")
    assert actions(df, "pred", ["date"]).count() == 400
    assert auc(df, "pred", "hit", ["date"]).count() == 8
    for made in (sp.with_stratified_fold(df, "y", 4, 1), sp.holdout(df, "y")):
        assert made.count() == 400
    counts = sp.with_stratified_fold(df, "y", 4, 1).where("y IS NULL").groupBy("fold").count().collect()
    assert len(counts) == 4 and max(r["count"] for r in counts) - min(r["count"] for r in counts) <= 1


def test_csv_schema_by_name(spark, tmp_path):
    (tmp_path / "t.csv").write_text("b,a,c\n2,1.5,NA\n,2.5,\n")
    schema = StructType([StructField("a", DoubleType()), StructField("b", LongType())])
    rows = read_table(spark, str(tmp_path / "t.csv"), schema).collect()
    assert [tuple(r) for r in rows] == [(1.5, 2), (2.5, None)]
    with pytest.raises(ValueError, match="not in the CSV header"):
        read_table(spark, str(tmp_path / "t.csv"), StructType([StructField("z", LongType())]))


def test_zip_text_and_equal_columns(spark, tmp_path):
    def put(name, text):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("train.csv", text)

    put("a.zip", "a,s\n1,NA\n2,\n")
    put("b.zip", "s,a\nx,3\n")
    rows = read_table(spark, str(tmp_path / "*.zip")).orderBy("a").collect()
    assert [(r.a, r.s) for r in rows] == [(1, "NA"), (2, None), (3, "x")]
    put("c.zip", "a,s,more\n4,y,1\n")
    with pytest.raises(ValueError, match="different columns"):
        read_table(spark, str(tmp_path / "*.zip"))


def test_named_features_are_not_prefixes(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "feature_1 double, feature_10 double")
    assert validate_structure(df, Roles(features=("feature_1",))).first().feature_count == 1


def test_correlation_over_complete_pairs(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    x = np.column_stack([x, x[:, 0] * 2 + 0.1 * x[:, 1], np.full(300, 0.1)])
    x[rng.random(x.shape) < 0.2] = np.nan
    names = [f"feature_{i}" for i in range(5)]
    table = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(row_id=range(300))).select(
        "row_id", *[F.when(~F.isnan(n), F.col(n)).alias(n) for n in names]
    )
    want = pd.DataFrame(x, columns=names).corr().abs()
    for width in (2000, 4):
        got = {(r.a, r.b): r.correlation for r in correlation_pairs(pack_features(table, R), 0.01, width=width).collect()}
        pairs = {(a, b) for i, a in enumerate(names[:4]) for b in names[i + 1 : 4] if want.loc[a, b] >= 0.01}
        assert set(got) == pairs and all(got[p] == pytest.approx(want.loc[p]) for p in pairs)


def test_constants_behind_a_gap_never_pair(spark):
    rng = np.random.default_rng(9)
    n = 700
    x = np.column_stack([np.full(n, 3.7), np.full(n, -0.3), rng.normal(size=n), rng.normal(size=n)])
    x[:300] = np.nan  # 300 empty leading rows
    x[300:400, 3] = 5.0  # constant over the rows it shares with feature 2 below
    x[400:, 2] = np.nan
    names = [f"feature_{i}" for i in range(4)]
    table = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(row_id=range(n))).select(
        "row_id", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in names]
    )
    for width in (2000, 2):
        got = correlation_pairs(pack_features(table, R), 0.0, width=width).collect()
        assert all(r.correlation <= 1.0 for r in got)
        pairs = {(r.a, r.b) for r in got}
        assert not pairs & {("feature_0", "feature_1"), ("feature_0", "feature_2"), ("feature_2", "feature_3")}
