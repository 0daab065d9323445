"""Reading, validation and cleaning: the loader cases of the survey plus edge rows."""

import zipfile
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from checks.tables import scan_zip_csv
from checks.views import raw_ticks
from quantloom import Roles, feature_columns
from quantloom.operators import cleaning as cl
from quantloom.plans.loading import load_processed, load_validated
from quantloom.session import materialise
from quantloom.sources import read_table

R = Roles(n_features=5)


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(42)
    n = 1000
    df = pd.DataFrame(
        {
            "date": rng.integers(0, 100, n),
            "weight": rng.uniform(0.5, 2.0, n),
            "resp": rng.normal(0, 0.1, n),
            "ts_id": range(n),
            **{f"feature_{i}": rng.normal(0, 1, n) for i in range(5)},
        }
    )
    df.loc[:4, "weight"] = 0.0
    df.loc[:9, "feature_0"] = np.nan
    return df


@pytest.fixture(scope="module")
def csv_path(sample, tmp_path_factory):
    path = tmp_path_factory.mktemp("csv") / "sample.csv"
    sample.to_csv(path, index=False)
    return str(path)


@pytest.fixture(scope="module")
def zip_path(csv_path, tmp_path_factory):
    path = tmp_path_factory.mktemp("zip") / "sample.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("other.csv", "a\n1\n")
        z.write(csv_path, "train.csv")
    return str(path)


def test_csv(spark, csv_path):
    df = read_table(spark, csv_path)
    assert df.count() == 1000 and dict(df.dtypes)["feature_0"] == "double"


def test_zip_prefers_train_csv_and_equals_csv(spark, csv_path, zip_path):
    a, b = read_table(spark, csv_path), read_table(spark, zip_path)
    assert dict(b.dtypes)["ts_id"] == "bigint" and dict(b.dtypes)["weight"] == "double"
    same = b.toPandas().sort_values("ts_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(same, a.toPandas().sort_values("ts_id").reset_index(drop=True), check_dtype=False)


def test_empty_archive_of_a_zipped_table_has_no_rows(spark, tmp_path):
    def pack(name, text):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("train.csv", text)

    pack("a.zip", "")
    with pytest.raises(ValueError, match="No columns"):
        read_table(spark, f"{tmp_path}/*.zip").count()
    pack("b.zip", "x,y\n")
    pack("c.zip", "x,y\n1,a\n2,\n")
    schema = StructType([StructField("y", StringType()), StructField("x", LongType())])
    for given in (schema, None):
        rows = read_table(spark, f"{tmp_path}/*.zip", given).select("x", "y").collect()
        assert sorted(map(tuple, rows)) == [(1, "a"), (2, None)]


def test_zip_query_with_partitions_without_rows(spark, tmp_path):
    """More splits than row groups: some partitions, and so their archives, hold no rows."""
    rows = [(i, datetime(2024, 1, 1, 0, 0, i), float(i), '{"k": 7}') for i in range(20)]
    made = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, value double, props string")
    made.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        assert raw_ticks(spark, str(tmp_path)).rdd.getNumPartitions() > 2
        assert sorted(r.event_id for r in scan_zip_csv(spark, str(tmp_path)).collect()) == list(range(20))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_zip_query_with_missing_values(spark, tmp_path):
    rows = [(1, None, 1.5, '{"k": 7}'), (123_456_789, datetime(2024, 1, 3), None, None), (None, datetime(2024, 1, 2), 2.0, '{"k": 3}')]
    made = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, value double, props string")
    made.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    wanted = sorted(map(tuple, raw_ticks(spark, str(tmp_path)).collect()), key=str)
    assert sorted(map(tuple, scan_zip_csv(spark, str(tmp_path)).collect()), key=str) == wanted


def test_zip_without_csv(spark, tmp_path):
    path = tmp_path / "empty.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("readme.txt", "nothing")
    with pytest.raises(Exception, match="No CSV files found"):
        read_table(spark, str(path))


def test_unknown_suffix(spark):
    with pytest.raises(ValueError, match="Unsupported file format"):
        read_table(spark, "test_file.txt")


def test_validation(spark, csv_path):
    row = cl.validate_structure(read_table(spark, csv_path), R).first()
    assert row["total_rows"] == 1000 and row["feature_count"] == 5 and row["features_match"]
    assert row["has_target"] and row["has_weight"] and row["has_date"] and row["trading_days"] == 100


def test_cleaning(spark, csv_path):
    table, meta = load_processed(read_table(spark, csv_path), R)
    assert table.count() == 995
    assert table.where("weight = 0").count() == 0
    assert table.where("feature_0 is null").count() == 0
    assert {r["y"] for r in table.select("y").distinct().collect()} == {0, 1}
    assert dict(table.dtypes)["feature_1"] == "float"
    assert feature_columns(table) == [f"feature_{i}" for i in range(5)]
    assert meta.first()["n_rows"] == 995 and meta.first()["has_weights"]


def test_description_includes_validation(spark, csv_path):
    _, meta = load_validated(read_table(spark, csv_path), R)
    assert meta.first()["total_rows"] == 1000 and meta.first()["n_rows"] == 995


def test_missing_target(spark):
    with pytest.raises(ValueError, match="not found"):
        cl.with_target(spark.createDataFrame([(1.0,)], "feature_0 double"), R)


def test_three_rows(spark):
    df = spark.createDataFrame(
        [(0, 1.0, 0.01, 1.0, 0.5), (1, 1.5, -0.005, 2.0, 1.5), (2, 0.8, 0.02, 3.0, 2.5)],
        "date int, weight double, resp double, feature_0 double, feature_1 double",
    )
    table, meta = load_processed(df, Roles(n_features=2))
    assert [r["y"] for r in table.orderBy("date").collect()] == [1, 0, 1]
    assert abs(meta.first()["positive_rate"] - 2 / 3) < 1e-12


def test_edge_values(spark):
    rows = [(1, None, None, float("nan")), (2, 0.0, 1.0, float("inf")), (3, -1.0, -1.0, 4.0)]
    df = spark.createDataFrame(rows, "ts_id int, weight double, resp double, feature_0 double")
    clean = cl.non_finite_to_null(df)
    assert [r["feature_0"] for r in clean.orderBy("ts_id").collect()] == [None, None, 4.0]
    kept = cl.drop_zero_weight(clean, R)
    assert {r["ts_id"] for r in kept.collect()} == {1, 3}
    assert {r["ts_id"]: r["y"] for r in cl.with_target(kept, R).collect()} == {1: 0, 3: 0}
    filled = cl.fill_mean(kept, ["feature_0"])
    assert {r["feature_0"] for r in filled.collect()} == {4.0}


def test_a_column_without_values_stays_missing(spark):
    df = spark.createDataFrame([(None,), (None,)], "feature_0 double")
    assert cl.fill_mean(df, ["feature_0"]).where("feature_0 is null").count() == 2


def test_missing_counts(spark):
    df = spark.createDataFrame([(None, 1), (float("nan"), None)], "a double, b int")
    assert {r["column"]: r["missing"] for r in cl.missing_counts(df).collect()} == {"a": 2, "b": 1}


def test_input_checks(spark):
    df = spark.createDataFrame([(1.0, 2)], "feature_0 double, y int")
    with pytest.raises(ValueError, match="Missing features"):
        cl.require_input(df, ["feature_9"])
    with pytest.raises(ValueError, match="empty"):
        cl.require_input(df.where("y = 0"), ["feature_0"])
    with pytest.raises(ValueError, match="0 and 1"):
        cl.require_binary(df, "y")
    with pytest.raises(ValueError, match="No feature columns"):
        feature_columns(df, "other_")


def test_zero_weight_filter_reaches_the_scan(spark, sample):
    stored = materialise(spark.createDataFrame(sample))
    plan = cl.drop_zero_weight(stored, R).select("ts_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(IsNull(weight),Not(EqualTo(weight,0.0)))]" in plan
