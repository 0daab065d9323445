"""From a raw table to features, target and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quantloom.operators.cleaning import (
    downcast_floats,
    drop_zero_weight,
    features_and_target,
    fill_mean,
    non_finite_to_null,
    require_input,
    validate_structure,
)
from quantloom.roles import Roles, feature_columns
from quantloom.sources import read_table


def load_processed(df: DataFrame, r: Roles, downcast: bool = True) -> tuple[DataFrame, DataFrame]:
    """Clean ``df`` (from ``read_table``): missing values unified, zero weights dropped, gaps
    filled with means, target added.

    Returns the table and a one-row description of it. One extra job fits the means;
    the rest stays lazy and is pushed into the scan.
    """
    clean = non_finite_to_null(df)
    if downcast:
        clean = downcast_floats(clean)
    kept = drop_zero_weight(clean, r)
    names = feature_columns(df, r.features)
    table = features_and_target(fill_mean(kept, names), r)
    # The target depends on the kept rows only, so the description need not wait for the means.
    meta = kept.agg(
        F.count("*").alias("n_rows"),
        F.avg(F.coalesce(F.col(r.target) > 0, F.lit(False)).cast("int")).alias("positive_rate"),
    ).select(
        "n_rows",
        F.lit(len(df.columns)).alias("n_columns"),
        F.lit(len(names)).alias("n_features"),
        "positive_rate",
        F.lit(r.weight in df.columns).alias("has_weights"),
    )
    return table, meta


def load_validated(df: DataFrame, r: Roles, downcast: bool = True) -> tuple[DataFrame, DataFrame]:
    """``load_processed`` with the structure checks of the raw table added to the description."""
    table, meta = load_processed(df, r, downcast)
    checks = validate_structure(df, r)
    return table, meta.join(F.broadcast(checks))  # one row each


def load_data(
    spark: SparkSession, path: str, r: Roles, schema: StructType | None = None, downcast: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Read, check and clean the table at ``path``; fails on a missing column or an empty table.

    The one-row description holds the structure checks, the feature names, and the shapes of
    features (``x_rows``, ``x_columns``) and target (``y_rows``) after cleaning.
    """
    raw = read_table(spark, path, schema)
    names = feature_columns(raw, r.features)
    require_input(raw, [*names, r.target])
    table, about = load_validated(raw, r, downcast)
    return table, about.select(
        "*",
        F.split(F.lit("\n".join(names)), "\n").alias("feature_columns"),
        F.col("n_rows").alias("x_rows"),
        F.col("n_features").alias("x_columns"),
        F.col("n_rows").alias("y_rows"),
    )
