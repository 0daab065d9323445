"""Principal components of a named feature array."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasOutputCol
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions import total
from quantloom.operators.arrays import map_arrays, shared_statistics, stats_of
from quantloom.operators.featureset import FEATURES, feature_names, named
from quantloom.operators.selection import all_correlations, at_positions


class _PcaWriter(MLWriter):
    def __init__(self, model: "PcaReducerModel"):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        m = self.model
        rows = [
            (i, n, float(m.mean[i]), float(m.scale[i]), [float(v) for v in m.loadings[i]])
            for i, n in enumerate(m.names)
        ]
        self.sparkSession.createDataFrame(
            rows, "i int, name string, mean double, scale double, loadings array<double>"
        ).write.parquet(f"{path}/features")
        parts = [(i, float(r), float(e)) for i, (r, e) in enumerate(zip(m.ratio, m.eigenvalues))]
        self.sparkSession.createDataFrame(parts, "i int, ratio double, eigenvalue double").write.parquet(
            f"{path}/components"
        )


class _PcaReader(MLReader):
    def load(self, path: str) -> "PcaReducerModel":
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        rows = self.sparkSession.read.parquet(f"{path}/features").orderBy("i").collect()
        parts = self.sparkSession.read.parquet(f"{path}/components").orderBy("i").collect()
        model = PcaReducerModel(
            [r["name"] for r in rows],
            np.array([r["mean"] for r in rows]),
            np.array([r["scale"] for r in rows]),
            np.array([r["loadings"] for r in rows]).reshape(len(rows), len(parts)),
            np.array([p["ratio"] for p in parts]),
            np.array([p["eigenvalue"] for p in parts]),
        )
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class PcaReducerModel(Model, HasFeaturesCol, HasOutputCol, MLReadable, MLWritable):
    """Fitted means, scales and loadings (features x components), small enough to ship to tasks."""

    def __init__(self, names=(), mean=None, scale=None, loadings=None, ratio=None, eigenvalues=None):
        super().__init__()
        self._setDefault(featuresCol=FEATURES, outputCol="pca")
        self.names = list(names)
        self.mean, self.scale, self.loadings = mean, scale, loadings
        self.ratio, self.eigenvalues = ratio, eigenvalues

    def write(self) -> MLWriter:
        return _PcaWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _PcaReader()

    @property
    def k(self) -> int:
        return len(self.ratio)

    def _inputs(self, df: DataFrame):
        """The fitted features in fitted order, whatever the order in ``df``."""
        column = self.getFeaturesCol()
        present = {n: i for i, n in enumerate(feature_names(df, column))}
        missing = [n for n in self.names if n not in present]
        if missing:
            raise ValueError(f"Missing features: {missing}")
        positions = [present[n] for n in self.names]
        if positions == list(range(len(present))):
            return F.col(column)
        return at_positions(column, positions, len(present))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        mean, scale, loadings = self.mean, self.scale, self.loadings

        def project(flat: pa.Array) -> pa.Array:
            x = flat.to_numpy(zero_copy_only=False).reshape(-1, len(mean))
            return pa.array((((x - mean) / scale) @ loadings).ravel(), from_pandas=True)  # NaN as null

        output = self.getOutputCol()
        others = [c for c in dataset.columns if c != output]
        names = [f"pca_{i}" for i in range(self.k)]
        return dataset.select(*others, named(map_arrays(self._inputs(dataset), project, self.k), names, output))

    def inverse(self, df: DataFrame, output: str = "restored") -> DataFrame:
        """Component scores back to the original features and units."""
        mean, scale, loadings = self.mean, self.scale, self.loadings

        @F.pandas_udf("array<double>")
        def restore(rows: pd.Series) -> pd.Series:
            if rows.empty:
                return rows
            return pd.Series(list((np.stack(rows.to_numpy()) @ loadings.T) * scale + mean))

        others = [c for c in df.columns if c != output]
        return df.select(*others, named(restore(F.col(self.getOutputCol())), self.names, output))

    def error(self, df: DataFrame, output: str = "reconstruction_error") -> DataFrame:
        """Add the mean squared difference between a row and its reconstruction."""
        restored = self.inverse(self.transform(df), "_restored")
        square = F.zip_with(self._inputs(df), "_restored", lambda a, b: (a - b) * (a - b))
        return restored.select(*df.columns, (total(square) / len(self.names)).alias(output))

    def importance(self, spark) -> DataFrame:
        """Absolute loadings weighted by explained variance, largest first."""
        scores = np.abs(self.loadings) @ self.ratio
        rows = [(n, float(s)) for n, s in zip(self.names, scores)]
        return spark.createDataFrame(rows, "feature string, importance double").orderBy(
            F.desc("importance"), "feature"
        )

    def components(self, spark) -> DataFrame:
        rows = [
            (f"PC{i + 1}", float(r), float(c), float(e))
            for i, (r, c, e) in enumerate(zip(self.ratio, np.cumsum(self.ratio), self.eigenvalues))
        ]
        return spark.createDataFrame(
            rows,
            "component string, variance_explained double, cumulative_variance double, eigenvalue double",
        )

    def metrics(self, spark, wanted: float = 0.95) -> DataFrame:
        """Dimensions before and after, reduction, variance kept, components for ``wanted``."""
        before, after = len(self.names), self.k
        enough = components_for(self.ratio, wanted)
        row = (before, after, (before - after) / before * 100, float(self.ratio.sum()), enough)
        return spark.createDataFrame(
            [row],
            "original_dimensions int, reduced_dimensions int, reduction_percentage double, "
            "variance_explained double, components_for_95_variance int",
        )


def components_for(ratio: np.ndarray, wanted: float) -> int:
    """Smallest number of components that explains ``wanted``; all of them if none does."""
    reached = np.flatnonzero(np.cumsum(ratio) >= wanted - 1e-12)
    return int(reached[0]) + 1 if len(reached) else len(ratio)


class PcaReducer(Estimator, HasFeaturesCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Fit components on standardised (or only centred) features.

    Two aggregating passes: moments and correlations. The covariance of standardised features
    is their correlation matrix, so one decomposition on the driver gives every ``k``; its size
    depends on the number of features only.
    """

    k = Param(Params._dummy(), "k", "components; 0 to choose by variance", TypeConverters.toInt)
    variance = Param(Params._dummy(), "variance", "share of variance to keep", TypeConverters.toFloat)
    scaled = Param(Params._dummy(), "scaled", "standardise first", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, k=0, variance=0.95, scaled=True, featuresCol=FEATURES, outputCol="pca"):
        super().__init__()
        self._setDefault(k=0, variance=0.95, scaled=True, featuresCol=FEATURES, outputCol="pca")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> PcaReducerModel:
        column = self.getFeaturesCol()
        names = feature_names(dataset, column)
        with shared_statistics():
            stats = stats_of(dataset, column, len(names))
            n = stats.rows
            if n < 2:
                raise ValueError("At least two rows are needed to fit components")
            if stats.missing.any():
                raise ValueError("Components cannot be fitted to missing values")
            mean, deviation, flat = stats.mean, np.sqrt(stats.variance()), stats.flat  # divisor n - 1
            matrix = all_correlations(dataset, column)
        matrix[flat, :] = 0.0
        matrix[:, flat] = 0.0
        if self.getOrDefault("scaled"):
            # Standardised with divisor n, measured with divisor n - 1.
            scale = np.where(flat, 1.0, deviation * np.sqrt((n - 1) / n))
            covariance = matrix * (n / (n - 1))
        else:
            scale = np.ones(len(names))
            covariance = matrix * np.outer(deviation, deviation)
        values, vectors_ = np.linalg.eigh(covariance)
        order = np.argsort(values)[::-1][: min(n, len(names))]
        values, loadings = np.maximum(values[order], 0.0), vectors_[:, order]
        ratio = values / values.sum() if values.sum() > 0 else np.zeros(len(values))
        k = self.getOrDefault("k") or components_for(ratio, self.getOrDefault("variance"))
        k = min(k, len(values))
        loadings = loadings[:, :k]
        # Eigenvectors are free in sign: make the largest loading of each positive.
        largest = loadings[np.abs(loadings).argmax(axis=0), np.arange(k)]
        loadings = loadings * np.where(largest < 0, -1.0, 1.0)
        model = PcaReducerModel(names, mean, scale, loadings, ratio[:k], values[:k])
        return self._copyValues(model)
