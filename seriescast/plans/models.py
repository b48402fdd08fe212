"""Tree models on MLlib: parameters, feature selection, scoring, per-tree draws."""

from __future__ import annotations

import json
import statistics
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriescast.operators import scale

SEED = 42
DEEPEST = 30  # MLlib's limit, used where depth is unlimited


@dataclass(frozen=True)
class ForestParams:
    n_estimators: int = 100
    max_depth: int | None = None
    min_samples_leaf: int = 1
    max_features: str = "log2"
    seed: int = SEED

    def estimator(self, features: str = "features", label: str = "label") -> RandomForestRegressor:
        return RandomForestRegressor(
            featuresCol=features, labelCol=label, numTrees=self.n_estimators,
            maxDepth=min(self.max_depth or DEEPEST, DEEPEST), minInstancesPerNode=self.min_samples_leaf,
            featureSubsetStrategy=str(self.max_features), seed=self.seed)


@dataclass(frozen=True)
class BoostParams:
    n_estimators: int = 100
    max_depth: int = 3
    learning_rate: float = 0.1
    subsample: float = 0.8
    max_features: str = "0.8"
    gamma: float = 0.0
    seed: int = SEED

    def estimator(self, features: str = "features", label: str = "label",
                  validation: str | None = None) -> GBTRegressor:
        gbt = GBTRegressor(
            featuresCol=features, labelCol=label, maxIter=self.n_estimators, maxDepth=self.max_depth,
            stepSize=self.learning_rate, subsamplingRate=self.subsample,
            featureSubsetStrategy=str(self.max_features), minInfoGain=self.gamma, seed=self.seed)
        return gbt.setValidationIndicatorCol(validation) if validation else gbt


PARAMS = {"rf": ForestParams, "xgb": BoostParams, "seq": ForestParams}


@dataclass
class TrainedModel:
    """A fitted pipeline with what is needed to build and scale its input."""

    kind: str
    pipeline: PipelineModel
    names: list[str]
    selected: list[str]
    n_lags: int
    label: str
    params: dict
    scaler: DataFrame | None = None
    sequence_length: int = 0
    metrics: dict[str, float] = field(default_factory=dict)
    training_end: str | None = None

    @property
    def regressor(self):
        return self.pipeline.stages[-1]

    def _scaled(self, frame: DataFrame, same: bool) -> DataFrame:
        """Pipeline input next to ``_center`` and ``_spread`` of the label."""
        if self.scaler is None:
            return frame.withColumns({"_center": F.lit(0.0), "_spread": F.lit(1.0)})
        return scale.apply_with_label(frame, self.scaler, self.names, self.label, same)

    def score(self, frame: DataFrame, same: bool = False) -> DataFrame:
        """``yhat`` in the units of the label next to all columns that are no features.

        ``same``: the frame has the series the scaler was fitted on.
        """
        predicted = self.pipeline.transform(self._scaled(frame, same))
        return predicted.withColumn(
            "yhat", F.col("prediction") * F.col("_spread") + F.col("_center")
        ).drop("features", "chosen", "prediction", "_center", "_spread", *self.names)

    def draws(self, frame: DataFrame, same: bool = False) -> DataFrame:
        """As ``score``, with ``draws``: every tree's prediction in the units of the label."""
        staged = self._scaled(frame, same)
        for stage in self.pipeline.stages[:-1]:
            staged = stage.transform(staged)
        staged, columns = tree_predictions(self.regressor, staged.drop(*self.names))
        unscaled = [F.col(c) * F.col("_spread") + F.col("_center") for c in columns]
        return staged.withColumn("draws", F.array(*unscaled)).drop(
            "features", "chosen", "_center", "_spread", *columns)

    def importances(self, spark: SparkSession) -> DataFrame:
        """Rows ``(name, importance)`` of the selected features; one per feature."""
        values = self.regressor.featureImportances.toArray().tolist()
        return spark.createDataFrame(list(zip(self.selected, values)), "name string, importance double")

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        spark = SparkSession.active()
        if self.scaler is not None:
            self.scaler.write.mode("overwrite").parquet(f"{path}/scaler")
        about = {k: getattr(self, k) for k in ("kind", "names", "selected", "n_lags", "label", "params",
                                               "sequence_length", "metrics", "training_end")}
        about["scaled"] = self.scaler is not None
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode(
            "overwrite").text(f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TrainedModel:
        about = json.loads(spark.read.text(f"{path}/about", wholetext=True).first()[0])
        scaler = spark.read.parquet(f"{path}/scaler") if about.pop("scaled") else None
        model = TrainedModel(pipeline=PipelineModel.load(f"{path}/pipeline"), scaler=scaler, **about)
        assembler = model.pipeline.stages[0]
        if list(assembler.getInputCols()) != model.names:
            raise ValueError("stored feature names differ from the pipeline's input columns")
        return model


def tree_predictions(forest, frame: DataFrame) -> tuple[DataFrame, list[str]]:
    """One prediction column per tree of a forest."""
    columns = []
    for i, tree in enumerate(forest.trees):
        columns.append(f"_tree_{i}")
        frame = tree.setPredictionCol(columns[-1]).transform(frame)
    return frame, columns


def assembler(names: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=names, outputCol="features")


def rank_importances(train: DataFrame, names: list[str], helper) -> list[tuple[int, str, float]]:
    """Importances of all features according to a helper model (50 trees by default)."""
    model = Pipeline(stages=[assembler(names), helper]).fit(train)
    values = model.stages[-1].featureImportances.toArray().tolist()
    return [(i, n, float(v)) for i, (n, v) in enumerate(zip(names, values))]


def choose(ranked: list[tuple[int, str, float]], threshold: str | float | None,
           max_features: int | None) -> list[int]:
    """Indices of the features to keep, in input order; never empty.

    The same rule as ``select_features``, for the short list of one fitted helper.
    """
    values = sorted(v for _, _, v in ranked)
    if threshold is None:
        bound = float("-inf")
    elif threshold == "median":
        bound = statistics.median(values)
    elif isinstance(threshold, str):
        bound = (float(threshold.split("*")[0]) if "*" in threshold else 1.0) * statistics.fmean(values)
    else:
        bound = threshold
    best = sorted(ranked, key=lambda r: (-r[2], r[0]))
    kept = [r for r in best if r[2] >= bound][:max_features] or best[:1]
    return sorted(i for i, _, _ in kept)


def fit_selected(train: DataFrame, names: list[str], indices: list[int] | None, estimator) -> PipelineModel:
    stages = [assembler(names)]
    if indices is None or len(indices) == len(names):
        stages.append(estimator.setFeaturesCol("features"))
    else:
        stages.append(VectorSlicer(inputCol="features", outputCol="chosen", indices=indices))
        stages.append(estimator.setFeaturesCol("chosen"))
    return Pipeline(stages=stages).fit(train)


def flatten_sequences(frame: DataFrame, length: int, width: int) -> tuple[DataFrame, list[str]]:
    """Sequences of rows as one column per cell, so that trees can read them."""
    names = [f"x{i}_{j}" for i in range(length) for j in range(width)]
    return frame.withColumns({
        f"x{i}_{j}": F.col("sequence")[i][j] for i in range(length) for j in range(width)
    }).drop("sequence"), names
