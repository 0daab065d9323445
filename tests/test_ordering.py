import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom import Roles
from quantloom.operators import indicators as ind
from quantloom.operators.ordering import block_rows_for, running_total, with_halo, with_row_id


def test_row_id_follows_the_key_order(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"), (F.col("id") % 3).alias("hot"))
    got = with_row_id(df, ["hot", "k"]).orderBy("row_id").toPandas()
    want = df.toPandas().sort_values(["hot", "k"]).reset_index(drop=True)
    assert list(got["row_id"]) == list(range(5000))
    assert list(got["k"]) == list(want["k"])


def test_row_id_of_an_empty_table(spark):
    assert with_row_id(spark.range(0), ["id"]).count() == 0


def test_running_total_with_a_hot_group(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 7).otherwise(99).alias("g"), "id", (F.col("id") % 5).alias("v")
    )
    got = running_total(df, ["g"], "id", "v", "below").toPandas().sort_values(["g", "id"])
    want = df.toPandas().sort_values(["g", "id"])
    want["below"] = want.groupby("g")["v"].cumsum() - want["v"]
    assert list(got["below"]) == list(want["below"])


@pytest.mark.parametrize("block_rows", [20, 64, 1000])
def test_halo_windows_equal_global_windows(spark, block_rows):
    df = spark.range(500).select(F.col("id").alias("row_id"), (F.col("id") * 37 % 101).alias("x"))
    over = Window.orderBy("row_id").rowsBetween(-19, 0)
    inside = Window.partitionBy("block").orderBy("row_id").rowsBetween(-19, 0)
    want = df.select("row_id", F.sum("x").over(over).alias("s"))
    got = (
        with_halo(df, "row_id", 19, block_rows)
        .withColumn("s", F.sum("x").over(inside))
        .where("own")
        .select("row_id", "s")
    )
    assert got.exceptAll(want).count() == 0 and got.count() == 500


def test_halo_needs_blocks_as_long_as_the_look_back(spark):
    with pytest.raises(ValueError):
        with_halo(spark.range(10).withColumnRenamed("id", "row_id"), "row_id", 5, 4)


def test_fill_carries_over_whole_blocks(spark):
    n = 700
    x = np.full(n, np.nan)
    x[3], x[410], x[690:] = 2.0, 5.0, 7.0  # gaps longer than several blocks
    pdf = pd.DataFrame({"row_id": np.arange(n), "feature_0": x, "feature_1": np.nan})
    df = spark.createDataFrame(pdf)
    got = (
        ind.momentum(df, Roles(), returns=(1, 5), windows=(), roc=(), trend=(), block_rows=40)
        .where("feature = 'feature_0'")
        .orderBy("row_id")
        .toPandas()
    )
    filled = pdf["feature_0"].ffill()
    for w in (1, 5):
        want = (filled / filled.shift(w) - 1).to_numpy()
        np.testing.assert_allclose(got[f"return_{w}"].to_numpy(float), want, equal_nan=True)


def test_block_rows_stay_above_the_look_back():
    assert block_rows_for(10, 99, 8) >= 4 * 99
    assert block_rows_for(10**12, 99, 1000) == 131_072


def test_indicators_shuffle_wide_rows_once(spark):
    df = spark.range(2000).select(F.col("id").alias("row_id"), F.rand(1).alias("feature_0"))
    rows = ind.indicator_rows(df, Roles(), ind.IndicatorSet(windows=(5,), lags=(1,), quantile_windows=(50,)))
    plan = ind.wide_columns(
        rows, Roles(), ["feature_0"], ind.IndicatorSet(windows=(5,), lags=(1,), quantile_windows=(50,))
    )._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
