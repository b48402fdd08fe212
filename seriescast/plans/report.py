"""Payloads and exports: what a training or forecasting run hands back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriescast.functions.calendar import future_dates
from seriescast.operators import diagnostics, split
from seriescast.operators.layout import BLOCK, block_of, index_series
from seriescast.plans.training import TrainResult


def day(c: str):
    return F.date_format(c, "yyyy-MM-dd")


def train_report(result: TrainResult) -> DataFrame:
    """One JSON document per series: metrics, features, parameters, correlograms."""
    spark = result.metrics.sparkSession
    model = result.model
    acf = diagnostics.correlogram(result.acf).withColumnRenamed("correlogram", "acf")
    pacf = diagnostics.correlogram(result.pacf).withColumnRenamed("correlogram", "pacf")
    about = spark.createDataFrame(
        [(model.kind, model.names, {k: str(v) for k, v in model.params.items()})],
        "model_type string, features_names array<string>, best_params map<string,string>").first()
    rows = result.metrics.join(acf, "ticker", "left").join(pacf, "ticker", "left")
    document = F.struct(
        F.lit("success").alias("status"), F.lit(about["model_type"]).alias("model_type"), "ticker",
        F.struct(*[F.col(m).alias(m.upper()) for m in ("mse", "rmse", "mae", "mape")]).alias("metrics"),
        F.array(*[F.lit(n) for n in about["features_names"]]).alias("features_names"),
        F.create_map(*[x for k, v in about["best_params"].items() for x in (F.lit(k), F.lit(v))])
        .alias("best_params"), "acf", "pacf")
    return rows.select("ticker", F.to_json(document).alias("report"))


def residual_pages(residuals: DataFrame, page: int = BLOCK) -> DataFrame:
    """Residuals and their dates in pages of at most ``page`` rows per series."""
    rows = index_series(residuals).withColumn("page", block_of(page))
    packed = F.array_sort(F.collect_list(F.struct("pos", day("ds").alias("d"), "residual")))
    return rows.groupBy("ticker", "page").agg(packed.alias("_p")).select(
        "ticker", "page", F.transform("_p", lambda r: r["d"]).alias("residual_dates"),
        F.transform("_p", lambda r: r["residual"]).alias("residuals"))


def forecast_report(bars: DataFrame, forecast: DataFrame, history_days: int = 252,
                    target: str = "close") -> DataFrame:
    """One JSON document per series: recent history, predictions, last actual value."""
    history = split.tail(bars, history_days).groupBy("ticker").agg(
        F.array_sort(F.collect_list(F.struct("ds", F.col(target).alias("v")))).alias("_h"))
    points = forecast.groupBy("ticker").agg(
        F.array_sort(F.collect_list(F.struct(
            "step", day("ds").alias("date"), "prediction", "lower_bound", "upper_bound"))).alias("_f"),
        F.max("model_used").alias("model_used"))
    document = F.struct(
        F.lit("success").alias("status"), "ticker", F.lit(target).alias("target_column"),
        F.size("_f").alias("forecast_horizon"),
        F.transform("_h", lambda r: F.date_format(r["ds"], "yyyy-MM-dd")).alias("historical_dates"),
        F.transform("_h", lambda r: r["v"]).alias("historical_values"),
        F.transform("_f", lambda r: F.struct(
            r["date"].alias("date"), r["prediction"].alias("prediction"),
            r["lower_bound"].alias("lower_bound"), r["upper_bound"].alias("upper_bound"))).alias("predictions"),
        F.date_format(F.element_at("_h", -1)["ds"], "yyyy-MM-dd").alias("last_actual_date"),
        F.element_at("_h", -1)["v"].alias("last_actual_value"), "model_used")
    return history.join(points, "ticker").select("ticker", F.to_json(document).alias("report"))


def export_rows(forecast: DataFrame) -> DataFrame:
    """Forecast rows as exported: date, value and interval as text with four decimals."""
    def four(c: str):
        return F.format_string("%.4f", F.col(c))

    return forecast.select(
        "ticker", "model_used", day("ds").alias("Fecha"), four("prediction").alias("Prediccion"),
        four("lower_bound").alias("Inferior"), four("upper_bound").alias("Superior"))


def export_csv(forecast: DataFrame, path: str) -> None:
    """CSV files under ``path/ticker=.../model_used=...``."""
    export_rows(forecast).repartition("ticker", "model_used").sortWithinPartitions("Fecha").write.mode(
        "overwrite").partitionBy("ticker", "model_used").option("header", True).csv(path)


def naive_forecast(bars: DataFrame, horizon: int, calendar: str = "business") -> DataFrame:
    """The last close repeated over the future dates, the benchmark every model has to beat."""
    last = split.last_actual(bars)
    return future_dates(last, horizon, calendar).join(last.select("ticker", "last_value"), "ticker").select(
        "ticker", "step", "ds", F.col("last_value").alias("prediction"), F.col("last_value").alias("lower_bound"),
        F.col("last_value").alias("upper_bound"), F.lit("naive").alias("model_used"))
