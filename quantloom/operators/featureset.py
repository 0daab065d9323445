"""All feature families side by side as one array column.

Thousands of derived features travel as ``features array<double>``; their names are kept in
the column's metadata, which selections and Parquet files preserve.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions import elements, finite
from quantloom.operators.crosssection import CROSS_SECTION, add_cross_section, interaction_columns
from quantloom.operators.indicators import ALL_INDICATORS, IndicatorSet, indicator_arrays
from quantloom.operators.ordering import dense_rows, with_row_id
from quantloom.roles import Roles, feature_columns

FEATURES = "features"


def named(values: Column, names: Sequence[str], column: str = FEATURES) -> Column:
    return values.alias(column, metadata={"names": list(names)})


def feature_names(df: DataFrame, column: str = FEATURES) -> list[str]:
    """Names of the elements of a feature array."""
    return list(df.schema[column].metadata["names"])


def pack_features(df: DataFrame, r: Roles, keep: Sequence[str] = ()) -> DataFrame:
    """Feature columns as one named array; missing and non-finite values are NULL."""
    names = feature_columns(df, r.features)
    values = F.array(*[finite(F.col(c).cast("double")) for c in names])
    return df.select(r.row_id, *keep, named(values, names))


def feature_values(df: DataFrame, keys: Sequence[str], column: str = FEATURES) -> DataFrame:
    """One row per element: ``(*keys, feature, value)``."""
    names = F.array(*[F.lit(n) for n in feature_names(df, column)])
    return df.select(*keys, elements(column, "_f", "value")).select(
        *keys, names[F.col("_f")].alias("feature"), "value"
    )


def unpack_features(df: DataFrame, keys: Sequence[str], column: str = FEATURES) -> DataFrame:
    """The array as plain columns; meant for some hundred features at most."""
    return df.select(
        *keys, *[F.col(column)[i].alias(n) for i, n in enumerate(feature_names(df, column))]
    )


def all_features(
    df: DataFrame,
    r: Roles,
    wanted: IndicatorSet = ALL_INDICATORS,
    keep: Sequence[str] = (),
    first: int = 10,
    limit: int = 50,
    block_rows: int | None = None,
) -> DataFrame:
    """Original features and every derived family per row.

    Adds one shuffle of the wide rows (see ``indicators``). If ``row_id`` has holes or repeats,
    rows are numbered anew inside and come out with the ``row_id`` they had.
    """
    count = dense_rows(df, r.row_id)
    if count is None:
        placed = with_row_id(df, [r.row_id], "_place")
        inner = replace(r, row_id="_place")
        return all_features(placed, inner, wanted, [r.row_id, *keep], first, limit, block_rows).drop("_place")
    names = feature_columns(df, r.features)
    families = wanted.outputs()
    early = ("lag", "rolling", "momentum", "volatility")
    cells = indicator_arrays(df, r, wanted, keep, [early, ["quantile"]], block_rows, count)
    row = add_cross_section(cells, "xs")
    made = interaction_columns(names, lambda n: F.col("xs")[names.index(n)], first, limit)

    parts, labels = [F.col("xs")], list(names)
    parts.append(F.col("group_0"))
    for family in early:
        labels += [f"{n}_{o}" for n in names for o in families[family]]
    parts.append(F.array(*[finite(F.col(c).cast("double")) for c in CROSS_SECTION]))
    labels += CROSS_SECTION
    if families["quantile"]:
        parts.append(F.col("group_1"))
        labels += [f"{n}_{o}" for n in names for o in families["quantile"]]
    if made:
        parts.append(F.array(*[finite(c) for c in made.values()]))
        labels += made
    return row.select(r.row_id, *keep, named(F.concat(*parts), labels))


def feature_summary(
    df: DataFrame, r: Roles, wanted: IndicatorSet = ALL_INDICATORS, first: int = 10, limit: int = 50
) -> DataFrame:
    """Number of columns per family, from the schema alone."""
    names = feature_columns(df, r.features)
    counts = [("original", len(names))]
    counts += [(family, len(names) * len(outputs)) for family, outputs in wanted.outputs().items()]
    counts.append(("cross_sectional", len(CROSS_SECTION)))
    counts.append(("interaction", len(interaction_columns(names, F.col, first, limit))))
    return df.sparkSession.createDataFrame(counts, "family string, columns long")
