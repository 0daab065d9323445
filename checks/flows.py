"""Whole flows: loading from a path, cross-validation by the name of a strategy."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fitted import TREES, training_table
from checks.views import rounded
from quantloom import Roles
from quantloom.operators import models as md
from quantloom.plans.evaluation import cross_validate_by
from quantloom.plans.loading import load_data

R = Roles()
LINES = Roles(
    features=("l_quantity", "l_extendedprice"),
    target="l_discount",
    weight="l_tax",
    date="l_linenumber",
    row_id="l_orderkey",
    n_features=2,
)


def load_from_path(spark, sf):
    _, about = load_data(spark, f"{sf}/lineitem.parquet", LINES)
    return rounded(about.withColumn("feature_columns", F.array_join("feature_columns", ",")))


def validation_by_name(spark, sf):
    """What a fold report says apart from the model: sizes and means of each fold, and sound scores."""
    report, _ = cross_validate_by(md.BoostedTrees(**TREES), training_table(spark, sf), R, "time_series", n=2)
    return rounded(
        report.select(
            "fold", "train_size", "test_size", "mean_return", "mean_weight", F.col("auc").between(0, 1).alias("auc_sound")
        )
    )


QUERIES = {"load_from_path": load_from_path, "cross_validation_by_name": validation_by_name}

SQL = {
    "load_from_path": """WITH kept AS (SELECT * FROM lineitem WHERE l_tax IS NULL OR l_tax <> 0)
      SELECT count(*) AS n_rows, (SELECT count(*) FROM (DESCRIBE lineitem))::INTEGER AS n_columns, 2 AS n_features,
        round(avg((l_discount > 0)::INTEGER) + 1.234e-9, 6) AS positive_rate, true AS has_weights,
        (SELECT count(*) FROM lineitem) AS total_rows, (SELECT count(*) FROM (DESCRIBE lineitem))::INTEGER AS total_columns,
        2 AS feature_count, 2 AS expected_features, true AS features_match, true AS has_target, true AS has_weight,
        true AS has_date, (SELECT min(l_linenumber) FROM lineitem) AS date_min,
        (SELECT max(l_linenumber) FROM lineitem) AS date_max,
        (SELECT count(DISTINCT l_linenumber) FROM lineitem) AS trading_days, 'l_quantity,l_extendedprice' AS feature_columns,
        count(*) AS x_rows, 2 AS x_columns, count(*) AS y_rows
      FROM kept""",
    "cross_validation_by_name": """WITH t AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS place,
        1e0 + 0.5e0 * (vec_id % 5) AS weight, ((vec_id * 7919) % 201 - 100) / 1000.0e0 AS resp FROM embeddings),
      f AS (SELECT fold::INTEGER AS fold, n - (2 - fold) * (n // 3) AS first, n // 3 AS size
        FROM (SELECT count(*) AS n FROM t), (SELECT unnest(range(2)) AS fold))
      SELECT fold, first AS train_size, size AS test_size, round(avg(resp) + 1.234e-9, 6) + 0e0 AS mean_return,
        round(avg(weight) + 1.234e-9, 6) + 0e0 AS mean_weight, true AS auc_sound
      FROM t JOIN f ON place >= first AND place < first + size GROUP BY fold, first, size""",
}
