"""Column roles shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Roles:
    """Names the columns an operator works on.

    ``features`` is a column-name prefix or an explicit tuple of columns.
    ``row_id`` is the dense global row index made by ``with_row_id``; Spark rows
    have no order of their own, so row-ordered operators need it.
    """

    features: str | tuple[str, ...] = "feature_"
    target: str = "resp"
    weight: str = "weight"
    date: str = "date"
    row_id: str = "row_id"
    n_features: int = 130


def feature_columns(df: DataFrame, features: str | tuple[str, ...] = "feature_") -> list[str]:
    """Feature columns in table order; reads the schema only, runs no job."""
    if isinstance(features, str):
        found = [c for c in df.columns if c.startswith(features)]
        if not found:
            raise ValueError(f"No feature columns found with prefix '{features}'")
        return found
    require_columns(df, features)
    return list(features)


def require_columns(df: DataFrame, columns) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Missing features: {missing}")
