"""Statistics across the features of one row, and products and ratios of feature pairs.

Both are plain projections: no shuffle, one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions import finite, ratio, total
from quantloom.roles import Roles, feature_columns

CROSS_SECTION = (
    "rank_mean",
    "rank_std",
    "feature_mean",
    "feature_std",
    "feature_median",
    "feature_skew",
    "feature_kurt",
    "n_positive",
    "n_negative",
    "n_extreme_positive",
    "n_extreme_negative",
)


def _quantile(q: float) -> Column:
    at = (F.col("_n") - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    value = F.get("_v", low)
    return value + (F.coalesce(F.get("_v", low + 1), value) - value) * (at - low)


def add_cross_section(df: DataFrame, xs: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Add the cross-section columns of the array ``xs``; missing elements are skipped."""
    zero, none = F.lit(0.0), F.lit(None).cast("double")
    n, mean = F.col("_n").cast("double"), F.col("feature_mean")

    def powers(acc: Column, x: Column) -> Column:
        d = x - mean
        square = d * d
        return F.struct(
            (acc["s2"] + square).alias("s2"),
            (acc["s3"] + square * d).alias("s3"),
            (acc["s4"] + square * square).alias("s4"),
        )

    def repeats(acc: Column, x: Column) -> Column:
        # A run of t equal values adds t^3 - t in the end, 3 k (k + 1) when it grows from k.
        again = F.coalesce(x == acc["x"], F.lit(False))
        run = F.when(again, acc["run"] + 1).otherwise(F.lit(1.0))
        grown = F.when(again, 3 * acc["run"] * (acc["run"] + 1)).otherwise(zero)
        return F.struct(x.alias("x"), run.alias("run"), (acc["ties"] + grown).alias("ties"))

    values = df.withColumn("_v", F.sort_array(F.filter(xs, lambda x: x.isNotNull())))
    values = values.withColumn("_n", F.size("_v"))
    values = values.withColumns(
        {
            "feature_mean": ratio(total(F.col("_v")), n),
            "_low": _quantile(low),
            "_high": _quantile(high),
            "_ties": F.aggregate(
                "_v",
                F.struct(none.alias("x"), zero.alias("run"), zero.alias("ties")),
                repeats,
                lambda acc: acc["ties"],
            ),
        }
    )
    values = values.withColumn(
        "_m",
        F.aggregate(
            "_v", F.struct(zero.alias("s2"), zero.alias("s3"), zero.alias("s4")), powers
        ),
    )
    flat = F.get("_v", F.lit(0)) == F.get("_v", F.col("_n") - 1)
    s2, s3, s4 = F.col("_m.s2"), F.col("_m.s3"), F.col("_m.s4")
    skew = n * F.sqrt(n - 1) / (n - 2) * ratio(s3, F.pow(s2, F.lit(1.5)))
    kurt = n * (n + 1) * (n - 1) * ratio(s4, (n - 2) * (n - 3) * s2 * s2) - 3 * (n - 1) * (n - 1) / (
        (n - 2) * (n - 3)
    )

    def counted(test) -> Column:
        return F.size(F.filter("_v", test)).cast("int")

    return values.withColumns(
        {
            "rank_mean": ratio(n + 1, 2 * n),
            "rank_std": F.when(n >= 2, F.sqrt((n * n * n - n - F.col("_ties")) / 12 / (n - 1)) / n),
            "feature_std": F.when(n >= 2, F.when(flat, zero).otherwise(F.sqrt(s2 / (n - 1)))),
            "feature_median": (
                F.get("_v", ((F.col("_n") - 1) / 2).cast("int")) + F.get("_v", (F.col("_n") / 2).cast("int"))
            )
            / 2,
            "feature_skew": F.when(n >= 3, F.when(flat, zero).otherwise(skew)),
            "feature_kurt": F.when(n >= 4, F.when(flat, zero).otherwise(kurt)),
            "n_positive": counted(lambda x: x > 0),
            "n_negative": counted(lambda x: x < 0),
            "n_extreme_positive": counted(lambda x: x > F.col("_high")),
            "n_extreme_negative": counted(lambda x: x < F.col("_low")),
        }
    ).select(*df.columns, *CROSS_SECTION)


def cross_section(df: DataFrame, r: Roles, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """The eleven cross-section columns per ``row_id``."""
    values = [finite(F.col(c).cast("double")) for c in feature_columns(df, r.features)]
    packed = df.select(r.row_id, F.array(*values).alias("xs"))
    return add_cross_section(packed, "xs", low, high).drop("xs")


def interaction_columns(
    names: list[str], value, first: int = 10, limit: int = 50
) -> dict[str, Column]:
    """Products and ratios of the first features by pair, alternating, up to ``limit``."""
    chosen = names[:first]
    out: dict[str, Column] = {}
    for i, a in enumerate(chosen):
        for b in chosen[i + 1 :]:
            out[f"{a}_{b}_mult"] = value(a) * value(b)
            out[f"{a}_{b}_div"] = ratio(value(a), value(b))
    return dict(list(out.items())[:limit])


def interactions(df: DataFrame, r: Roles, first: int = 10, limit: int = 50) -> DataFrame:
    """``{a}_{b}_mult`` and ``{a}_{b}_div`` per ``row_id``; a zero denominator gives NULL."""
    made = interaction_columns(feature_columns(df, r.features), F.col, first, limit)
    return df.select(r.row_id, *[c.alias(n) for n, c in made.items()])
