"""Feature preparation: derive, impute, select, compress, scale."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import ratio
from quantloom.operators.arrays import shared_statistics, shared_stats, stats_of
from quantloom.operators.featureset import FEATURES, feature_names
from quantloom.operators.pca import PcaReducer
from quantloom.operators.selection import (
    Decorrelate,
    ImputeFeatures,
    IndicatorFeatures,
    LowVariance,
    StandardScale,
)
from quantloom.roles import Roles
from quantloom.session import materialise

STEPS = {
    IndicatorFeatures: "technical_indicators",
    ImputeFeatures: "imputation",
    LowVariance: "low_variance_removal",
    Decorrelate: "correlation_removal",
    PcaReducer: "pca_reduction",
    StandardScale: "final_scaling",
}
FROM_STATS = (ImputeFeatures, LowVariance, Decorrelate, PcaReducer)  # fitted from a table's statistics
STATS_SCHEMA = (
    "position int, step string, n_features int, n_samples long, missing_values long, "
    "missing_percentage double, memory_usage_mb double"
)


def feature_prep(
    indicators: bool = True,
    impute: str = "median",
    low_variance: float | None = 0.01,
    correlation: float | None = 0.95,
    pca: float | None = 0.95,
    scale: bool = True,
    prefix: str = "feature_",
    row_id: str = "row_id",
    keep: Sequence[str] = (),
    lookbacks: Sequence[int] | None = None,
    quantile_windows: Sequence[int] | None = None,
) -> Pipeline:
    """The unfitted stages; ``None`` or ``False`` switches one off. PCA output is not rescaled."""
    stages = [
        IndicatorFeatures(
            prefix=prefix,
            rowCol=row_id,
            keepCols=list(keep),
            derive=indicators,
            lookbacks=list(lookbacks) if lookbacks else None,
            quantileWindows=list(quantile_windows) if quantile_windows else None,
        ),
        ImputeFeatures(strategy=impute),
    ]
    if low_variance is not None:
        stages.append(LowVariance(threshold=low_variance))
    if correlation is not None:
        stages.append(Decorrelate(threshold=correlation))
    if pca is not None:
        stages.append(PcaReducer(variance=pca, outputCol=FEATURES))
    elif scale:
        stages.append(StandardScale())
    return Pipeline(stages=stages)


def stage_stats(df: DataFrame, step: str, position: int, column: str = FEATURES) -> DataFrame:
    """One row about a stage's output: features, rows, missing values, size of the values."""
    width = len(feature_names(df, column))
    known = shared_stats(df, column)
    if known is not None and width:
        counts = [(known.rows, int(known.missing.sum()))]
        counted = df.sparkSession.createDataFrame(counts, "n_samples long, missing_values long")
    else:
        missing = F.size(F.filter(column, lambda x: x.isNull()))
        counted = df.agg(
            F.count("*").alias("n_samples"),
            F.coalesce(F.sum(missing), F.lit(0)).cast("long").alias("missing_values"),
        )
    return counted.select(
        F.lit(position).alias("position"),
        F.lit(step).alias("step"),
        F.lit(width).alias("n_features"),
        "n_samples",
        "missing_values",
        ratio(F.col("missing_values") * 100.0, F.col("n_samples") * F.lit(float(width))).alias(
            "missing_percentage"
        ),
        (F.col("n_samples") * F.lit(width * 8 / 1024 / 1024)).alias("memory_usage_mb"),
    )


def fit_feature_prep(
    df: DataFrame, prep: Pipeline, r: Roles
) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """Fit stage by stage: the fitted model, the prepared table and the statistics per stage.

    Imputation appears in the statistics only where something was missing. A table's statistics
    are computed once for all that ask for them, and follow from those of the table before where
    a stage fills or drops features; these stages are applied anew by each reader, which costs
    less than storing their output. Components are stored.
    """
    fitted, stats, noted = [], [], None

    def note(table: DataFrame, step: str) -> None:
        nonlocal noted
        if table is noted:  # the last noted table once more
            stats.append((len(stats), step, *stats[-1][2:]))
            return
        stats.append(tuple(stage_stats(table, step, len(stats)).first()))  # one row
        noted = table

    source = IndicatorFeatures(prefix=r.features, rowCol=r.row_id, derive=False).transform(df)
    note(source, "input")
    current = df
    stages = prep.getStages()
    with shared_statistics():
        for stage, following in zip(stages, [*stages[1:], None]):
            model = stage if isinstance(stage, Transformer) else stage.fit(current)
            before, current = current, model.transform(current)
            fitted.append(model)
            if isinstance(stage, PcaReducer) and current is not before:
                current = materialise(current, "prepared")
            elif isinstance(following, FROM_STATS):
                stats_of(current, FEATURES, len(feature_names(current)))
            skipped = isinstance(stage, ImputeFeatures) and model.getOrDefault("whole")
            packed = isinstance(stage, IndicatorFeatures) and not stage.getOrDefault("derive")
            if not skipped and not packed:
                note(current, STEPS[type(stage)])
        note(current, "output")
    return PipelineModel(fitted), current, df.sparkSession.createDataFrame(stats, STATS_SCHEMA)


def prep_summary(stats: DataFrame) -> DataFrame:
    """Per step: features before, after and removed, share removed, missing share, size."""
    before = F.lag("n_features").over(Window.orderBy("position"))  # one row per stage
    steps = stats.where("step <> 'output'").withColumn("features_before", before)
    removed = F.col("features_before") - F.col("n_features")
    return steps.where("step <> 'input'").select(
        "position",
        "step",
        "features_before",
        F.col("n_features").alias("features_after"),
        removed.alias("features_removed"),
        F.coalesce(ratio(removed * 100.0, F.col("features_before").cast("double")), F.lit(0.0)).alias(
            "removal_percentage"
        ),
        "missing_percentage",
        "memory_usage_mb",
    )


def reduction_analysis(stats: DataFrame) -> DataFrame:
    """Features at the start and at the end, their ratio and the reduction in percent."""
    ends = stats.agg(
        F.max(F.when(F.col("step") == "input", F.col("n_features"))).alias("original_features"),
        F.max(F.when(F.col("step") == "output", F.col("n_features"))).alias("final_features"),
    )
    share = ratio(F.col("final_features").cast("double"), F.col("original_features").cast("double"))
    return ends.select(
        "original_features",
        "final_features",
        share.alias("reduction_ratio"),
        ((1 - share) * 100).alias("reduction_percentage"),
    )
