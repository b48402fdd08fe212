"""Stored models and the table that lists them."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriescast.operators.align import model_type
from seriescast.plans.models import TrainedModel

SCHEMA = T.StructType([
    T.StructField("model_name", T.StringType()), T.StructField("model_type", T.StringType()),
    T.StructField("ticker", T.StringType()),
    T.StructField("best_params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("feature_importances", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()), T.StructField("importance", T.DoubleType())]))),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("created_at", T.TimestampType()), T.StructField("training_end_date", T.DateType()),
])


def text_params(params: dict) -> dict[str, str]:
    """Parameters of any type as text for a map column; lists and None as JSON."""
    return {k: v if isinstance(v, str) else json.dumps(v) for k, v in params.items()}


def save_model(model: TrainedModel, folder: str, name: str, ticker: str | None = None,
               created_at: dt.datetime | None = None) -> str:
    """Store the model under ``folder/name`` and append its row to the registry."""
    spark = SparkSession.active()
    path = f"{folder}/models/{name}"
    model.save(path)
    weights = getattr(model.regressor, "featureImportances", None)
    importances = None if weights is None else list(zip(model.selected, weights.toArray().tolist()))
    row = (name, model_type(model.kind), ticker, text_params(model.params), importances, model.metrics,
           created_at or dt.datetime.now(), model.training_end and dt.date.fromisoformat(model.training_end))
    spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/registry")
    return path


def load_model(spark: SparkSession, folder: str, name: str) -> TrainedModel:
    return TrainedModel.load(spark, f"{folder}/models/{name}")


def registry(spark: SparkSession, folder: str) -> DataFrame:
    """The newest row of every model name; no rows in an empty store."""
    try:
        rows = spark.read.schema(SCHEMA).parquet(f"{folder}/registry")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)
    newest = F.max_by(F.struct(*[c for c in SCHEMA.names if c != "model_name"]), F.col("created_at"))
    return rows.groupBy("model_name").agg(newest.alias("r")).select("model_name", "r.*")


def list_models(spark: SparkSession, folder: str) -> DataFrame:
    """Registry rows with the size of the stored files; only file names and lengths are read."""
    rows = registry(spark, folder)
    if rows.isEmpty():
        return rows.withColumns({"size_bytes": F.lit(None).cast("long"), "size_mb": F.lit(None).cast("double")})
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{folder}/models")
    sizes = files.select(
        F.regexp_extract("path", "/models/([^/]+)/", 1).alias("model_name"), "length"
    ).groupBy("model_name").agg(F.sum("length").alias("size_bytes"))
    return rows.join(sizes, "model_name", "left").withColumn(
        "size_mb", F.round(F.col("size_bytes") / 1048576, 2))
