"""Time-series feature engineering and evaluation on Spark DataFrames."""

from quantloom.roles import Roles, feature_columns

__all__ = ["Roles", "feature_columns"]
