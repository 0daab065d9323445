"""Classifiers on a named feature array, built from Spark ML.

Fitting returns a plain ``PipelineModel`` that adds ``probability`` and the score ``pred``
(probability of class 1), so saving, loading and copying are Spark's own.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import (
    HasFeaturesCol,
    HasLabelCol,
    HasOutputCol,
    HasPredictionCol,
    HasProbabilityCol,
    HasSeed,
    HasWeightCol,
)
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions import ratio
from quantloom.operators.cleaning import require_binary
from quantloom.operators.featureset import FEATURES, feature_names
from quantloom.operators.pca import PcaReducer
from quantloom.operators.scoring import predicted
from quantloom.operators.selection import at_positions
from quantloom.operators.splits import holdout
from quantloom.operators.utility import utility_columns
from quantloom.roles import Roles
from quantloom.session import checkpoint_root

_VECTOR, _WEIGHT, _VALIDATION = "_vector", "_class_weight", "is_validation"


class ToVector(Transformer, HasFeaturesCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Feature array to an ML vector in the fitted order; fails on absent features."""

    names = Param(Params._dummy(), "names", "features in fitted order", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, names=None, featuresCol=FEATURES, outputCol=_VECTOR):
        super().__init__()
        self._setDefault(featuresCol=FEATURES, outputCol=_VECTOR)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        column, wanted = self.getFeaturesCol(), self.getOrDefault("names")
        present = {n: i for i, n in enumerate(feature_names(dataset, column))}
        missing = [n for n in wanted if n not in present]
        if missing:
            raise ValueError(f"Missing features: {missing}")
        positions = [present[n] for n in wanted]
        whole = positions == list(range(len(present)))
        values = F.col(column) if whole else at_positions(column, positions, len(present))
        return dataset.withColumn(self.getOutputCol(), array_to_vector(values))


class Score(Transformer, HasProbabilityCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Probability of class 1 as a plain column; drops the helper columns."""

    @keyword_only
    def __init__(self, *, probabilityCol="probability", outputCol="pred"):
        super().__init__()
        self._setDefault(probabilityCol="probability", outputCol="pred")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        score = vector_to_array(self.getProbabilityCol())[1]
        return dataset.withColumn(self.getOutputCol(), score).drop(_VECTOR, "rawPrediction", "prediction")


def score_column(df: DataFrame) -> Column:
    """The score of any fitted model: ``pred``, else P(1), else the predicted value."""
    if "pred" in df.columns:
        return F.col("pred")
    if "probability" in df.columns:
        return vector_to_array("probability")[1]
    return F.col("prediction").cast("double")


def predict(df: DataFrame, pred: str = "pred", name: str = "predicted") -> DataFrame:
    """Class 1 for a score above one half."""
    return df.withColumn(name, predicted(F.col(pred), 0.5, inclusive=False))


def class_weight(df: DataFrame, y: str) -> DataFrame:
    """One row: negatives, positives, and negatives per positive (1 without positives)."""
    counts = df.agg(F.count_if(F.col(y) == 0).alias("negatives"), F.count_if(F.col(y) == 1).alias("positives"))
    weight = F.coalesce(ratio(F.col("negatives").cast("double"), F.col("positives").cast("double")), F.lit(1.0))
    return counts.select("negatives", "positives", weight.alias("class_weight"))


class BoostedTrees(
    Estimator, HasFeaturesCol, HasLabelCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable
):
    """Gradient-boosted trees with class weights and early stopping on a stratified hold-out."""

    rounds = Param(Params._dummy(), "rounds", "most boosting rounds", TypeConverters.toInt)
    depth = Param(Params._dummy(), "depth", "tree depth", TypeConverters.toInt)
    rate = Param(Params._dummy(), "rate", "learning rate", TypeConverters.toFloat)
    rowShare = Param(Params._dummy(), "rowShare", "rows sampled per tree", TypeConverters.toFloat)
    columnShare = Param(Params._dummy(), "columnShare", "features sampled per node", TypeConverters.toFloat)
    minRows = Param(Params._dummy(), "minRows", "least rows in a leaf", TypeConverters.toInt)
    minGain = Param(Params._dummy(), "minGain", "least gain of a split", TypeConverters.toFloat)
    validation = Param(Params._dummy(), "validation", "hold-out share, 0 for none", TypeConverters.toFloat)
    tolerance = Param(Params._dummy(), "tolerance", "stop below this gain in loss", TypeConverters.toFloat)
    positiveWeight = Param(Params._dummy(), "positiveWeight", "0 to balance classes", TypeConverters.toFloat)
    rowCol = Param(Params._dummy(), "rowCol", "unique row key", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, rounds=500, depth=6, rate=0.1, rowShare=0.8, columnShare=0.8, minRows=1,
                 minGain=0.0, validation=0.2, tolerance=0.01, positiveWeight=0.0, rowCol="row_id",
                 featuresCol=FEATURES, labelCol="y", seed=42):
        super().__init__()
        self._setDefault(
            rounds=500, depth=6, rate=0.1, rowShare=0.8, columnShare=0.8, minRows=1, minGain=0.0,
            validation=0.2, tolerance=0.01, positiveWeight=0.0, rowCol="row_id",
            featuresCol=FEATURES, labelCol="y", seed=42,
        )
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        get, y, column = self.getOrDefault, self.getLabelCol(), self.getFeaturesCol()
        names = feature_names(dataset, column)
        require_binary(dataset, y)
        weight = get("positiveWeight") or class_weight(dataset, y).first()["class_weight"]
        rows = dataset.select(get("rowCol"), y, column)
        if get("validation") > 0:
            rows = holdout(rows, y, get("validation"), self.getSeed(), get("rowCol"))
        rows = rows.withColumn(_WEIGHT, F.when(F.col(y) == 1, F.lit(float(weight))).otherwise(1.0))
        to_vector = ToVector(names=names, featuresCol=column)
        trees = GBTClassifier(
            featuresCol=_VECTOR,
            labelCol=y,
            weightCol=_WEIGHT,
            maxIter=get("rounds"),
            maxDepth=get("depth"),
            stepSize=get("rate"),
            subsamplingRate=get("rowShare"),
            featureSubsetStrategy=str(get("columnShare")) if get("columnShare") < 1 else "all",
            minInstancesPerNode=get("minRows"),
            minInfoGain=get("minGain"),
            validationTol=get("tolerance"),
            seed=self.getSeed(),
        )
        if get("validation") > 0:
            trees = trees.setValidationIndicatorCol(_VALIDATION)
        return PipelineModel([to_vector, trees.fit(to_vector.transform(rows)), Score()])


class EncoderMlp(
    Estimator, HasFeaturesCol, HasLabelCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable
):
    """A linear encoder (principal components) with a perceptron head on the encoded features."""

    k = Param(Params._dummy(), "k", "encoded features", TypeConverters.toInt)
    hidden = Param(Params._dummy(), "hidden", "hidden layer widths", TypeConverters.toListInt)
    maxIter = Param(Params._dummy(), "maxIter", "most iterations", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, k=64, hidden=None, maxIter=100, featuresCol=FEATURES, labelCol="y", seed=42):
        super().__init__()
        self._setDefault(
            k=64, hidden=[128, 64, 32], maxIter=100, featuresCol=FEATURES, labelCol="y", seed=42
        )
        self._set(**{name: v for name, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        y = self.getLabelCol()
        require_binary(dataset, y)
        encoder = PcaReducer(
            k=self.getOrDefault("k"), featuresCol=self.getFeaturesCol(), outputCol="encoded"
        ).fit(dataset)
        names = [f"pca_{i}" for i in range(encoder.k)]
        to_vector = ToVector(names=names, featuresCol="encoded")
        head = MultilayerPerceptronClassifier(
            featuresCol=_VECTOR,
            labelCol=y,
            layers=[encoder.k, *self.getOrDefault("hidden"), 2],
            maxIter=self.getOrDefault("maxIter"),
            seed=self.getSeed(),
        )
        encoded = to_vector.transform(encoder.transform(dataset)).select(_VECTOR, y)
        return PipelineModel([encoder, to_vector, head.fit(encoded), Score()])


def encode(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Encoded features ``encoded_0..`` as the array ``encoded``."""
    made = model.stages[0].transform(df)
    names = [f"encoded_{i}" for i in range(model.stages[0].k)]
    return made.withMetadata("encoded", {"names": names})


def anomaly_score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Reconstruction error of the encoder per row."""
    return model.stages[0].error(df, "anomaly_score")


def _trees(model: PipelineModel) -> GBTClassificationModel:
    return next(s for s in model.stages if isinstance(s, GBTClassificationModel))


def split_importance(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Share of splits per feature, largest first; unused features have 0.

    Reads the node table Spark writes when it saves the trees.
    """
    spark, names = df.sparkSession, model.stages[0].getOrDefault("names")
    trees = _trees(model)
    path = f"{checkpoint_root(spark)}/quantloom/trees-{trees.uid}"
    trees.write().overwrite().save(path)
    counts = (
        spark.read.parquet(f"{path}/data")
        .where("nodeData.leftChild >= 0")
        .groupBy(F.col("nodeData.split.featureIndex").alias("i"))
        .agg(F.count("*").alias("splits"))
    )
    listed = spark.createDataFrame(list(enumerate(names)), "i int, feature string")
    splits = F.coalesce("splits", F.lit(0))
    every = listed.join(counts, "i", "left").select("feature", splits.alias("splits"))
    total = every.agg(F.sum("splits").alias("total"))
    return every.join(F.broadcast(total)).select(
        "feature",
        F.coalesce(ratio(F.col("splits").cast("double"), F.col("total").cast("double")), F.lit(0.0)).alias(
            "importance"
        ),
    ).orderBy(F.desc("importance"), "feature")


def gain_importance(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Share of the loss reduction per feature, largest first."""
    names, gains = model.stages[0].getOrDefault("names"), _trees(model).featureImportances.toArray()
    rows = [(n, float(g)) for n, g in zip(names, gains)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


def top_importance(importance: DataFrame, n: int = 20) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(n)


def training_history(model: PipelineModel, train: DataFrame, validation: DataFrame, y: str = "y") -> DataFrame:
    """Loss per boosting round on both tables: ``(round, train_loss, validation_loss)``."""
    trees, to_vector = _trees(model), model.stages[0]

    def losses(df: DataFrame) -> list[float]:
        rows = to_vector.transform(df).withColumn(_WEIGHT, F.lit(1.0))
        return list(trees.evaluateEachIteration(rows))

    rows = [
        (i + 1, float(a), float(b)) for i, (a, b) in enumerate(zip(losses(train), losses(validation)))
    ]
    return train.sparkSession.createDataFrame(rows, "round int, train_loss double, validation_loss double")


class UtilityEvaluator(
    Evaluator, HasPredictionCol, HasWeightCol, DefaultParamsReadable, DefaultParamsWritable
):
    """Utility as an ML evaluator, for ``CrossValidator`` and the like; larger is better."""

    returnCol = Param(Params._dummy(), "returnCol", "return column", TypeConverters.toString)
    threshold = Param(Params._dummy(), "threshold", "least score to trade", TypeConverters.toFloat)
    penalty = Param(Params._dummy(), "penalty", "cost per trade", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, predictionCol="pred", weightCol="weight", returnCol="resp", threshold=0.5, penalty=0.0):
        super().__init__()
        self._setDefault(
            predictionCol="pred", weightCol="weight", returnCol="resp", threshold=0.5, penalty=0.0
        )
        self._set(**self._input_kwargs)

    def _evaluate(self, dataset: DataFrame) -> float:
        name = self.getPredictionCol()
        is_vector = isinstance(dataset.schema[name].dataType, VectorUDT)
        pred = vector_to_array(name)[1] if is_vector else F.col(name)
        r = Roles(target=self.getOrDefault("returnCol"), weight=self.getWeightCol())
        measured = utility_columns(
            pred, r, self.getOrDefault("threshold"), self.getOrDefault("penalty")
        )
        return dataset.agg(measured).first()[0]

    def isLargerBetter(self) -> bool:
        return True
