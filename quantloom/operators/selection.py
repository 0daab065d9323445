"""Fitted stages over a named feature array: imputation, selection, scaling.

Every stage is a Spark ML estimator on the column ``features array<double>`` whose names are
in the column metadata. Statistics are grouped aggregates over (feature, value) rows, so the
shuffle carries one partial result per feature and task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions import double_array, elements
from quantloom.operators.arrays import (
    blocks_of,
    feature_stats,
    fill_elements,
    pick_elements,
    share_stats,
    shared_statistics,
    shared_stats,
    stats_of,
)
from quantloom.operators.featureset import FEATURES, all_features, feature_names, named, pack_features
from quantloom.operators.indicators import ALL_INDICATORS, LOOKBACKS, QUANTILE_WINDOWS, IndicatorSet
from quantloom.operators.quantiles import array_quantiles, exact_quantiles
from quantloom.roles import Roles
from quantloom.session import materialise

# A correlation pass keeps four times width^2 numbers per task: 128 MB.
WIDTH = 2000
STRATEGIES = ("median", "mean", "most_frequent", "constant")


def cells(df: DataFrame, column: str = FEATURES) -> DataFrame:
    """One row per element: ``(f, x)``."""
    return df.select(elements(column))


def at_positions(column: str, positions: list[int], width: int) -> Column:
    """The elements at ``positions`` of an array of ``width`` elements, in that order.

    The array is named once and outside every lambda: Spark may put its defining expression
    in place of the name, and inside a lambda that would be evaluated per element.
    """
    place = [-1] * width
    for target, source in enumerate(positions):
        place[source] = target
    placed = F.zip_with(
        column, double_array(place), lambda x, at: F.struct(at.alias("at"), x.alias("x"))
    )
    kept = F.filter(placed, lambda pair: pair["at"] >= 0)
    if list(positions) != sorted(positions):
        kept = F.array_sort(kept)
    return F.transform(kept, lambda pair: pair["x"])


def missing_total(df: DataFrame, column: str = FEATURES) -> int:
    return int(stats_of(df, column, len(feature_names(df, column))).missing.sum())


class _Stage(HasFeaturesCol, DefaultParamsReadable, DefaultParamsWritable):
    def _named(self, df: DataFrame, values: Column, names: list[str]) -> DataFrame:
        column = self.getFeaturesCol()
        others = [c for c in df.columns if c != column]
        return df.select(*others, named(values, names, column))


# Derived and packed features ------------------------------------------------------------------


class IndicatorFeatures(Transformer, _Stage):
    """Feature columns to the full array of derived features.

    The result is stored, since each later stage reads it at least once to fit.
    """

    prefix = Param(Params._dummy(), "prefix", "feature column prefix", TypeConverters.toString)
    rowCol = Param(Params._dummy(), "rowCol", "dense row index", TypeConverters.toString)
    keepCols = Param(Params._dummy(), "keepCols", "columns to carry", TypeConverters.toListString)
    lookbacks = Param(Params._dummy(), "lookbacks", "rolling windows", TypeConverters.toListInt)
    quantileWindows = Param(
        Params._dummy(), "quantileWindows", "quantile windows", TypeConverters.toListInt
    )
    derive = Param(Params._dummy(), "derive", "false to pack the features only", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, prefix="feature_", rowCol="row_id", keepCols=None, lookbacks=None,
                 quantileWindows=None, derive=True, featuresCol=FEATURES):
        super().__init__()
        self._setDefault(
            prefix="feature_", rowCol="row_id", keepCols=[], lookbacks=list(LOOKBACKS),
            quantileWindows=list(QUANTILE_WINDOWS), derive=True, featuresCol=FEATURES,
        )
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        r = Roles(features=self.getOrDefault("prefix"), row_id=self.getOrDefault("rowCol"))
        keep = self.getOrDefault("keepCols")
        if not self.getOrDefault("derive"):
            return pack_features(dataset, r, keep)
        look = tuple(self.getOrDefault("lookbacks"))
        base = ALL_INDICATORS
        wanted = IndicatorSet(
            lags=base.lags, windows=look, returns=base.returns, momentum=look, roc=base.roc,
            trend=base.trend, dispersion_windows=look,
            quantile_windows=tuple(self.getOrDefault("quantileWindows")),
        )
        return materialise(all_features(dataset, r, wanted, keep), "features")


# Imputation -----------------------------------------------------------------------------------


class ImputeModel(Model, _Stage):
    """Fills missing elements; features that had no value at all in the fit are dropped."""

    fills = Param(Params._dummy(), "fills", "value per kept feature", TypeConverters.toListFloat)
    kept = Param(Params._dummy(), "kept", "kept features", TypeConverters.toListString)
    whole = Param(Params._dummy(), "whole", "nothing was missing in the fit", TypeConverters.toBoolean)

    def __init__(self):
        super().__init__()
        self._setDefault(featuresCol=FEATURES, whole=False)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        column, kept = self.getFeaturesCol(), self.getOrDefault("kept")
        if self.getOrDefault("whole"):
            return dataset
        names = feature_names(dataset, column)
        absent = [n for n in kept if n not in set(names)]
        if absent:
            raise ValueError(f"Missing features: {absent}")
        at = {n: i for i, n in enumerate(names)}
        positions, fills = [at[n] for n in kept], self.getOrDefault("fills")
        values = F.col(column) if kept == names else pick_elements(column, positions, len(names))
        filled = self._named(dataset, fill_elements(values, fills), kept)
        known = shared_stats(dataset, column)
        if known is not None:
            share_stats(filled, column, known.picked(positions).filled(fills))
        return filled


class ImputeFeatures(Estimator, _Stage):
    """Fit the value that replaces missing elements; identity when nothing is missing."""

    strategy = Param(Params._dummy(), "strategy", "one of " + ", ".join(STRATEGIES), TypeConverters.toString)
    fillValue = Param(Params._dummy(), "fillValue", "for strategy constant", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, strategy="median", fillValue=0.0, featuresCol=FEATURES):
        super().__init__()
        self._setDefault(strategy="median", fillValue=0.0, featuresCol=FEATURES)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ImputeModel:
        column, strategy = self.getFeaturesCol(), self.getOrDefault("strategy")
        if strategy not in STRATEGIES:
            raise ValueError(f"Unknown imputation strategy: {strategy}")
        model = ImputeModel()._set(featuresCol=column)
        with shared_statistics():
            if missing_total(dataset, column) == 0:
                return model._set(kept=[], fills=[], whole=True)
            found = fill_values(dataset, strategy, column, self.getOrDefault("fillValue"))
        fills = {row["f"]: row["fill"] for row in found.collect()}  # one row per feature
        names = feature_names(dataset, column)
        kept = [i for i in range(len(names)) if fills.get(i) is not None]
        return model._set(kept=[names[i] for i in kept], fills=[fills[i] for i in kept])


def fill_values(df: DataFrame, strategy: str, column: str = FEATURES, constant: float = 0.0) -> DataFrame:
    """``(f, fill)`` per feature with at least one value (every feature for a constant)."""
    if strategy == "median":
        found = array_quantiles(df, column, len(feature_names(df, column)), [0.5])
        return found.select("f", F.col("value").alias("fill"))
    values = cells(df, column)
    if strategy == "constant":
        return values.select("f").distinct().select("f", F.lit(float(constant)).alias("fill"))
    known = values.where("x is not null")
    if strategy == "mean":
        return known.groupBy("f").agg(F.avg("x").alias("fill"))
    # Counting first makes a value held by most rows one row; ties go to the smallest value.
    counts = known.groupBy("f", "x").agg(F.count("*").alias("n"))
    return counts.groupBy("f").agg(F.min_by("x", F.struct(-F.col("n"), "x")).alias("fill"))


# Selection ------------------------------------------------------------------------------------


class DropFeatures(Model, _Stage):
    """Drops named features; names that are absent are ignored."""

    dropped = Param(Params._dummy(), "dropped", "names to drop", TypeConverters.toListString)

    def __init__(self):
        super().__init__()
        self._setDefault(featuresCol=FEATURES, dropped=[])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        column, gone = self.getFeaturesCol(), set(self.getOrDefault("dropped"))
        names = feature_names(dataset, column)
        kept = [i for i, n in enumerate(names) if n not in gone]
        if len(kept) == len(names):
            return dataset
        left = self._named(dataset, pick_elements(column, kept, len(names)), [names[i] for i in kept])
        known = shared_stats(dataset, column)
        if known is not None:
            share_stats(left, column, known.picked(kept))
        return left


def feature_variances(df: DataFrame, column: str = FEATURES) -> DataFrame:
    """Sample variance per feature: ``(f, variance)``."""
    stats = feature_stats(df, column, len(feature_names(df, column)))
    spread = F.when(F.col("low") == F.col("high"), F.when(F.col("m2").isNotNull(), F.lit(0.0))).otherwise(F.col("m2"))
    return stats.select("f", F.when(F.col("n") > 1, spread / (F.col("n") - 1)).alias("variance"))


class LowVariance(Estimator, _Stage):
    """Drop features with sample variance up to the threshold."""

    threshold = Param(Params._dummy(), "threshold", "largest variance to drop", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, threshold=0.01, featuresCol=FEATURES):
        super().__init__()
        self._setDefault(threshold=0.01, featuresCol=FEATURES)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> DropFeatures:
        column = self.getFeaturesCol()
        names = feature_names(dataset, column)
        variance = stats_of(dataset, column, len(names)).variance()
        dropped = np.flatnonzero(variance <= self.getOrDefault("threshold"))
        return DropFeatures()._set(featuresCol=column, dropped=[names[i] for i in dropped])


def correlation_matrix(df: DataFrame, positions: list[int], column: str = FEATURES) -> np.ndarray:
    """Pearson correlations of the chosen features: their means, then one pass over their products.

    A task adds up one matrix and hands on one row per pair. Constant features give NaN.
    """
    width, count = len(feature_names(df, column)), len(positions)
    whole = positions == list(range(width))
    values = F.col(column) if whole else at_positions(column, positions, width)
    mean = stats_of(df, column, width).mean[positions]
    read = blocks_of(count)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((count, count))
        for x, _ in read(batches):
            x = x - mean
            sums += x.T @ x
        i, j = np.triu_indices(count)
        parts = [i.astype(np.int32), j.astype(np.int32), sums[i, j]]
        for at in range(0, len(i), _PAIR_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(p[at : at + _PAIR_ROWS]) for p in parts], names=["a", "b", "s"])

    tasks = max(1, df.sparkSession.sparkContext.defaultParallelism)
    products = df.select(values.alias("v")).coalesce(tasks).mapInArrow(multiply, "a int, b int, s double")
    found = products.groupBy("a", "b").agg(F.sum("s").alias("s")).toArrow()  # at most WIDTH^2 / 2 rows
    a, b, s = (found[c].to_numpy() for c in ("a", "b", "s"))
    matrix = np.zeros((count, count))
    matrix[a, b] = matrix[b, a] = s
    spread = np.sqrt(np.diag(matrix))
    with np.errstate(all="ignore"):
        matrix /= np.outer(spread, spread)
    matrix[np.diag_indices(count)] = 1.0
    return matrix


def all_correlations(df: DataFrame, column: str = FEATURES, width: int = WIDTH) -> np.ndarray:
    """The whole correlation matrix, filled by passes over at most ``width`` features."""
    total = len(feature_names(df, column))
    whole = np.empty((total, total))
    for block in _column_blocks(total, width):
        whole[np.ix_(block, block)] = correlation_matrix(df, block, column)
    return whole


def _pair_sums(values: DataFrame, least: np.ndarray) -> DataFrame:
    """Sums over the rows in which both features of a pair have a value: ``a, b, n, sx, sy, sxx, syy, sxy``.

    One scan. A task adds up matrices of ``width`` by ``width`` and hands on one row per pair, so
    there are no more tasks than cores. Values are taken from ``least``, their feature's least
    value over all rows, which makes the sums of a constant feature exactly zero and keeps the
    others small.
    """
    width = len(least)
    first = np.where(np.isfinite(least), least, 0.0)
    read = blocks_of(width)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sx, sxx, sxy = (np.zeros((width, width)) for _ in range(4))
        for x, _ in read(batches):
            x = x - first
            there = np.isfinite(x)
            if there.all():  # nothing missing: sums of a feature are the same in all its pairs
                n += len(x)
                sx += x.sum(axis=0)[:, None]
                sxx += (x * x).sum(axis=0)[:, None]
                sxy += x.T @ x
                continue
            x, there = np.where(there, x, 0.0), there.astype(float)
            n += there.T @ there
            sx += x.T @ there
            sxx += (x * x).T @ there
            sxy += x.T @ x
        i, j = np.triu_indices(width, 1)
        parts = [i.astype(np.int32), j.astype(np.int32), n[i, j], sx[i, j], sx[j, i], sxx[i, j], sxx[j, i], sxy[i, j]]
        for at in range(0, len(i), _PAIR_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(p[at : at + _PAIR_ROWS]) for p in parts], names=_PAIR_NAMES)

    schema = "a int, b int, " + ", ".join(f"{c} double" for c in _PAIR_NAMES[2:])
    tasks = max(1, values.sparkSession.sparkContext.defaultParallelism)
    summed = values.coalesce(tasks).mapInArrow(add_up, schema)
    return summed.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in _PAIR_NAMES[2:]])


_PAIR_ROWS = 100_000
_ROUNDING = 1e-12  # relative spread that sums of doubles cannot tell from none
_PAIR_NAMES = ["a", "b", "n", "sx", "sy", "sxx", "syy", "sxy"]


def correlation_pairs(
    df: DataFrame, threshold: float = 0.95, column: str = FEATURES, width: int = WIDTH
) -> DataFrame:
    """Pairs i < j with absolute correlation at or over the threshold: ``(i, j, a, b, correlation)``.

    Over the rows in which both have a value. A pass handles at most ``width`` features, as its
    sums grow with their square; wider arrays take one pass per pair of half-width column
    blocks. Features constant over the rows a pair shares never qualify, wherever their values
    begin; correlations are at most 1. The pairs stay in Spark.
    """
    names = feature_names(df, column)
    least = stats_of(df, column, len(names)).low
    every = F.split(F.lit("\n".join(names)), "\n")
    found = []
    for block in _column_blocks(len(names), width):
        whole = block == list(range(len(names)))
        values = F.col(column) if whole else at_positions(column, block, len(names))
        sums = _pair_sums(df.select(values.alias("v")), least[block])
        at = F.array(*[F.lit(i) for i in block]) if not whole else None
        i, j = (F.col("a"), F.col("b")) if whole else (F.get(at, F.col("a")), F.get(at, F.col("b")))
        # A spread below rounding of its own sums is none: the feature is constant over the
        # rows the pair shares, and such a pair has no correlation.
        sx_spread = F.col("n") * F.col("sxx") - F.col("sx") ** 2
        sy_spread = F.col("n") * F.col("syy") - F.col("sy") ** 2
        real = (sx_spread > _ROUNDING * F.col("n") * F.col("sxx")) & (sy_spread > _ROUNDING * F.col("n") * F.col("syy"))
        spread = F.when(real, sx_spread * sy_spread)
        r = F.when(real, F.least(F.abs((F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(spread)), F.lit(1.0)))
        found.append(sums.select(i.alias("i"), j.alias("j"), r.alias("correlation")).where(F.col("correlation") >= threshold))
    pairs = reduce(DataFrame.union, found)
    if len(found) > 1:  # features of one block meet in several passes
        pairs = pairs.groupBy("i", "j").agg(F.max("correlation").alias("correlation"))
    return pairs.select("i", "j", F.get(every, F.col("i")).alias("a"), F.get(every, F.col("j")).alias("b"), "correlation")


def _column_blocks(total: int, width: int) -> list[list[int]]:
    if total <= width:
        return [list(range(total))]
    half = max(1, width // 2)
    parts = [list(range(s, min(s + half, total))) for s in range(0, total, half)]
    return [a + b for i, a in enumerate(parts) for b in parts[i + 1 :]]


class Decorrelate(Estimator, _Stage):
    """Of each correlated pair still complete, drop the feature of lower variance."""

    threshold = Param(Params._dummy(), "threshold", "least correlation to act on", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, threshold=0.95, featuresCol=FEATURES):
        super().__init__()
        self._setDefault(threshold=0.95, featuresCol=FEATURES)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> DropFeatures:
        column = self.getFeaturesCol()
        with shared_statistics():
            pairs = correlation_pairs(dataset, self.getOrDefault("threshold"), column)
            variance = stats_of(dataset, column, len(feature_names(dataset, column))).variance()
        dropped: set[int] = set()
        # The choice depends on the pairs before it; only the qualifying pairs get here.
        for pair in pairs.orderBy("i", "j").collect():
            i, j = pair["i"], pair["j"]
            if not {i, j} & dropped:
                dropped.add(i if variance[i] < variance[j] else j)
        names = feature_names(dataset, column)
        return DropFeatures()._set(featuresCol=column, dropped=[names[i] for i in sorted(dropped)])


# Scaling --------------------------------------------------------------------------------------


class ScaleModel(Model, _Stage):
    """``(x - centre) / scale`` per feature; missing elements stay missing."""

    names = Param(Params._dummy(), "names", "fitted features", TypeConverters.toListString)
    centre = Param(Params._dummy(), "centre", "subtracted", TypeConverters.toListFloat)
    scale = Param(Params._dummy(), "scale", "divisor", TypeConverters.toListFloat)

    def __init__(self):
        super().__init__()
        self._setDefault(featuresCol=FEATURES)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        column, names = self.getFeaturesCol(), self.getOrDefault("names")
        if feature_names(dataset, column) != names:
            raise ValueError("Features differ from the fitted ones")
        centred = F.zip_with(column, double_array(self.getOrDefault("centre")), lambda x, c: x - c)
        scaled = F.zip_with(centred, double_array(self.getOrDefault("scale")), lambda x, s: x / s)
        return self._named(dataset, scaled, names)


class _Scaler(Estimator, _Stage):
    @keyword_only
    def __init__(self, *, featuresCol=FEATURES):
        super().__init__()
        self._setDefault(featuresCol=FEATURES)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ScaleModel:
        column = self.getFeaturesCol()
        found = {r["f"]: r for r in self._statistics(dataset, column).collect()}
        names = feature_names(dataset, column)
        return ScaleModel()._set(
            featuresCol=column,
            names=names,
            centre=[found[i]["centre"] if i in found else 0.0 for i in range(len(names))],
            scale=[(found[i]["scale"] or 1.0) if i in found else 1.0 for i in range(len(names))],
        )


class StandardScale(_Scaler):
    """Mean 0 and population deviation 1; constant features are only centred."""

    def _statistics(self, df: DataFrame, column: str) -> DataFrame:
        flat = F.min("x") == F.max("x")
        return cells(df, column).groupBy("f").agg(
            F.coalesce(F.avg("x"), F.lit(0.0)).alias("centre"),
            F.when(flat, 1.0).otherwise(F.stddev_pop("x")).alias("scale"),
        )


class RobustScale(_Scaler):
    """Median 0 and interquartile range 1; missing elements count as 0 in the fit only."""

    def _statistics(self, df: DataFrame, column: str) -> DataFrame:
        known = cells(df, column).withColumn("x", F.coalesce("x", F.lit(0.0)))
        found = exact_quantiles(known, "x", [0.25, 0.5, 0.75], ["f"])

        def at(q: float) -> Column:
            return F.max(F.when(F.col("q") == q, F.col("value")))

        return found.groupBy("f").agg(
            at(0.5).alias("centre"),
            F.when(at(0.75) == at(0.25), 1.0).otherwise(at(0.75) - at(0.25)).alias("scale"),
        )
