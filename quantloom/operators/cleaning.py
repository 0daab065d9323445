"""Validation and cleaning of the raw table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from quantloom.functions import finite
from quantloom.roles import Roles, feature_columns, require_columns


def validate_structure(df: DataFrame, r: Roles) -> DataFrame:
    """One row describing rows, columns, roles and the range of days."""
    if isinstance(r.features, str):
        found = [c for c in df.columns if c.startswith(r.features)]
    else:
        found = [c for c in r.features if c in df.columns]
    has_date = r.date in df.columns
    date = F.col(r.date) if has_date else F.lit(None).cast("int")
    return df.agg(
        F.count("*").alias("total_rows"),
        F.min(date).alias("date_min"),
        F.max(date).alias("date_max"),
        (F.countDistinct(date) if has_date else F.lit(None).cast("long")).alias("trading_days"),
    ).select(
        "total_rows",
        F.lit(len(df.columns)).alias("total_columns"),
        F.lit(len(found)).alias("feature_count"),
        F.lit(r.n_features).alias("expected_features"),
        F.lit(len(found) == r.n_features).alias("features_match"),
        F.lit(r.target in df.columns).alias("has_target"),
        F.lit(r.weight in df.columns).alias("has_weight"),
        F.lit(has_date).alias("has_date"),
        "date_min",
        "date_max",
        "trading_days",
    )


def _floating(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))]


def non_finite_to_null(df: DataFrame) -> DataFrame:
    """NaN and infinities of all floating columns become NULL."""
    return df.withColumns({c: finite(F.col(c)) for c in _floating(df)})


def downcast_floats(df: DataFrame) -> DataFrame:
    """Every DOUBLE column as FLOAT."""
    doubles = [f.name for f in df.schema if isinstance(f.dataType, DoubleType)]
    return df.withColumns({c: F.col(c).cast("float") for c in doubles})


def drop_zero_weight(df: DataFrame, r: Roles) -> DataFrame:
    """Drop rows of weight 0; rows without a weight stay."""
    if r.weight not in df.columns:
        return df
    return df.where(F.col(r.weight).isNull() | (F.col(r.weight) != 0))


def feature_means(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Mean of each column in one pass; columns without any value are left out."""
    row = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    return {c: row[c] for c in columns if row[c] is not None}


def fill_mean(df: DataFrame, columns: Sequence[str], means: dict[str, float] | None = None) -> DataFrame:
    """NULLs of ``columns`` become the column's mean, or the ``means`` fitted earlier."""
    means = feature_means(df, columns) if means is None else means
    return df.fillna(means) if means else df


def missing_counts(df: DataFrame) -> DataFrame:
    """Missing values per column: ``(column, missing)``."""
    floating = set(_floating(df))

    def missing(c: str) -> Column:
        gone = F.col(c).isNull()
        return F.count_if(gone | F.isnan(c) if c in floating else gone)

    counts = df.agg(*[missing(c).alias(c) for c in df.columns])
    return counts.unpivot([], counts.columns, "column", "missing")


def with_target(df: DataFrame, r: Roles, name: str = "y") -> DataFrame:
    """Binary target: 1 for a positive return, else 0."""
    if r.target not in df.columns:
        raise ValueError(f"Target column '{r.target}' not found")
    return df.withColumn(name, F.coalesce(F.col(r.target) > 0, F.lit(False)).cast("int"))


def features_and_target(df: DataFrame, r: Roles) -> DataFrame:
    """Keys, features and target side by side, so that nothing needs aligning later."""
    keys = [c for c in (r.row_id, r.date, r.weight, r.target) if c in df.columns]
    return with_target(df, r).select(*keys, *feature_columns(df, r.features), "y")


def require_input(df: DataFrame, columns: Sequence[str]) -> None:
    """Fail on missing columns (schema only) or on an empty table (reads one row)."""
    require_columns(df, columns)
    if df.isEmpty():
        raise ValueError("Input data is empty")


def require_binary(df: DataFrame, column: str) -> None:
    odd = df.where(F.col(column).isNull() | ~F.col(column).isin(0, 1))
    if not odd.isEmpty():
        raise ValueError(f"Target '{column}' must hold only 0 and 1")
