"""Weighted blends of several models' scores."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReader,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions import double_array
from quantloom.operators.models import BoostedTrees, EncoderMlp
from quantloom.operators.scoring import auc
from quantloom.operators.splits import stratified_folds, with_stratified_fold
from quantloom.operators.utility import improvement, utility_columns
from quantloom.roles import Roles
from quantloom.session import materialise, shuffle_partitions

WEIGHTS = {"encoder": 0.3, "boosted": 0.7}
GRID = tuple(i / 20 for i in range(21))
TASK_SCORES = 400_000  # scores a task makes and counts at once, about 50 MB
PART_SCORES = 1_500_000  # scores in a shuffle partition, on average


def normalise_weights(weights: Mapping[str, float]) -> dict[str, float]:
    """Weights that sum to 1."""
    whole = sum(weights.values())
    if math.isclose(whole, 1.0):
        return dict(weights)
    return {name: w / whole for name, w in weights.items()}


def blend_column(members: Sequence[str], weights: Mapping[str, float]) -> Column:
    """Weighted mean of the score columns ``members``; the weights may name more models."""
    unknown = [m for m in members if m not in weights]
    if unknown:
        raise ValueError(f"Unknown models in predictions: {unknown}")
    whole = sum(weights[m] for m in members)
    mixed = sum((F.col(m) * float(weights[m]) for m in members[1:]), F.col(members[0]) * float(weights[members[0]]))
    return mixed if math.isclose(whole, 1.0) else mixed / float(whole)


def blend(df: DataFrame, members: Sequence[str], weights: Mapping[str, float], name: str = "blend") -> DataFrame:
    """Add the blended score; a projection."""
    return df.withColumn(name, blend_column(members, weights))


def contributions(df: DataFrame, members: Sequence[str], weights: Mapping[str, float], keys: Sequence[str]) -> DataFrame:
    """Per row: each member's score, its weighted part and weight, and the blend."""
    return df.select(
        *keys,
        *[F.col(m).alias(f"{m}_pred") for m in members],
        *[(F.col(m) * float(weights[m])).alias(f"{m}_contribution") for m in members],
        blend_column(members, weights).alias("ensemble_pred"),
        *[F.lit(float(weights[m])).alias(f"{m}_weight") for m in members],
    )


def blend_weight_scores(
    df: DataFrame, first: str, second: str, y: str, fold: str = "fold", grid: Sequence[float] = GRID
) -> DataFrame:
    """Mean fold AUC for every weight of ``first``: ``(weight, mean_auc)``.

    The members are trained once per fold. Rows are dealt over tasks by their number before each
    becomes one per weight, so the counts of scores that a task holds do not grow with the table.
    All weights are scored in one job where their scores fit the session's shuffle partitions,
    otherwise in several, down to one weight each.
    """
    rows = materialise(df.select(fold, y, first, second), "blend")
    n, room = rows.count(), PART_SCORES * shuffle_partitions(df.sparkSession)
    size = -(-len(grid) // max(1, min(len(grid), -(-n * len(grid) // room))))
    mixed = F.col("weight") * F.col(first) + (1 - F.col("weight")) * F.col(second)
    found = []
    for some in (grid[at : at + size] for at in range(0, len(grid), size)):
        dealt = rows.repartition(max(1, -(-n * len(some) // TASK_SCORES)))
        tried = dealt.select("*", F.explode(double_array(some)).alias("weight"))
        found.append(auc(tried.withColumn("mixed", mixed), "mixed", y, ["weight", fold]))
    scored = reduce(DataFrame.union, found)
    return scored.groupBy("weight").agg(F.avg("auc").alias("mean_auc"))


def search_blend_weight(df: DataFrame, first: str, second: str, y: str, fold: str = "fold", grid: Sequence[float] = GRID) -> DataFrame:
    """The weight of ``first`` with the best mean AUC (the smallest on ties)."""
    scored = blend_weight_scores(df, first, second, y, fold, grid)
    best = F.min_by(F.struct("weight", "mean_auc"), F.struct(-F.col("mean_auc"), "weight"))
    return scored.agg(best.alias("best")).select(
        F.col("best.weight").alias("first_weight"),
        (1 - F.col("best.weight")).alias("second_weight"),
        F.col("best.mean_auc").alias("mean_auc"),
    )


def evaluate_blend(df: DataFrame, blended: str, baseline: str, r: Roles, target: float = 12.0) -> DataFrame:
    """Utility of the blend against the baseline, in one pass."""
    both = df.agg(
        utility_columns(F.col(blended), r).alias("ensemble_utility"),
        utility_columns(F.col(baseline), r).alias("baseline_utility"),
    )
    pct = improvement(F.col("baseline_utility"), F.col("ensemble_utility"))
    return both.select(
        "ensemble_utility",
        "baseline_utility",
        (F.col("ensemble_utility") - F.col("baseline_utility")).alias("absolute_improvement"),
        pct.alias("improvement_percentage"),
        (pct >= target).alias("meets_target"),
    )


class _BlendWriter(MLWriter):
    def __init__(self, model: "BlendModel"):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m = self.model
        extra = {"members": list(m.members), "initial": m.initial, "optimised": m.optimised}
        DefaultParamsWriter.saveMetadata(
            m, path, self.sparkSession, extraMetadata={"blend": extra}
        )
        for name, member in m.members.items():
            member.write().save(f"{path}/{name}")


class _BlendReader(MLReader):
    def load(self, path: str) -> "BlendModel":
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        extra = metadata["blend"]
        members = {n: PipelineModel.load(f"{path}/{n}") for n in extra["members"]}
        model = BlendModel(members, extra["initial"], extra["optimised"])
        model._resetUid(metadata["uid"])
        return model


class BlendModel(Model, MLReadable, MLWritable):
    """Fitted members and their weights; adds one score column per member and ``pred``."""

    def __init__(self, members=None, initial=None, optimised=None):
        super().__init__()
        self.members = members or {}
        self.initial, self.optimised = initial, optimised

    @property
    def weights(self) -> dict[str, float]:
        return self.optimised or self.initial

    def write(self) -> MLWriter:
        return _BlendWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _BlendReader()

    def member_predictions(self, df: DataFrame) -> DataFrame:
        """One score column per member."""
        columns = list(df.columns)
        for name, member in self.members.items():
            scored = member.transform(df)
            df = scored.select(*columns, F.col("pred").alias(name))
            columns.append(name)
        return df

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return blend(self.member_predictions(dataset), list(self.members), self.weights, "pred")

    def contributions(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        return contributions(self.member_predictions(df), list(self.members), self.weights, keys)

    def evaluate(self, df: DataFrame, r: Roles, baseline: str = "boosted", target: float = 12.0) -> DataFrame:
        return evaluate_blend(self.transform(df), "pred", baseline, r, target)

    def training_summary(self, spark) -> DataFrame:
        """One row: members, initial, optimised and final weights."""
        row = (len(self.members), list(self.members), self.initial, self.weights, self.optimised is not None, self.optimised)
        return spark.createDataFrame(
            [row],
            "n_members int, members array<string>, initial_weights map<string,double>, "
            "final_weights map<string,double>, weights_optimised boolean, optimised_weights map<string,double>",
        )


class Blend(Estimator):
    """Fit the encoder and the boosted member on the same rows, then choose their weights.

    Weights come from out-of-fold scores: each member is trained once per stratified fold.
    """

    folds = Param(Params._dummy(), "folds", "folds of the weight search", TypeConverters.toInt)
    optimise = Param(Params._dummy(), "optimise", "search the weights", TypeConverters.toBoolean)
    seed = Param(Params._dummy(), "seed", "seed of the folds", TypeConverters.toInt)
    rowCol = Param(Params._dummy(), "rowCol", "unique key of the rows", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, encoder=None, boosted=None, weights=None, optimise=True, folds=3, seed=42, rowCol="row_id"):
        super().__init__()
        self._setDefault(folds=3, optimise=True, seed=42, rowCol="row_id")
        self._set(optimise=optimise, folds=folds, seed=seed, rowCol=rowCol)
        self.members = {"encoder": encoder or EncoderMlp(), "boosted": boosted or BoostedTrees()}
        self.weights = normalise_weights(weights or WEIGHTS)

    def copy(self, extra=None) -> "Blend":
        made = Blend(
            encoder=self.members["encoder"].copy(),
            boosted=self.members["boosted"].copy(),
            weights=self.weights,
        )
        return self._copyValues(made, extra)

    def _fit(self, dataset: DataFrame) -> BlendModel:
        from quantloom.plans.evaluation import out_of_fold

        optimised = None
        if self.getOrDefault("optimise"):
            y = self.members["boosted"].getLabelCol()
            n = self.getOrDefault("folds")
            key = self.getOrDefault("rowCol")
            rows = with_stratified_fold(dataset, y, n, self.getOrDefault("seed"), key)
            members = {m: out_of_fold(e, rows, stratified_folds(n), [key, y]) for m, e in self.members.items()}
            scores = members["encoder"].withColumnRenamed("pred", "encoder").join(
                members["boosted"].select(key, F.col("pred").alias("boosted")), key
            )
            best = search_blend_weight(scores, "encoder", "boosted", y).first()
            if best["first_weight"] is not None:
                optimised = {"encoder": best["first_weight"], "boosted": best["second_weight"]}
        fitted = {name: member.fit(dataset) for name, member in self.members.items()}
        return BlendModel(fitted, self.weights, optimised)
