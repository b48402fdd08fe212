"""Forecast requests against stored models."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriescast.operators.align import resolve_models
from seriescast.operators.layout import with_series_values
from seriescast.plans.forecast import forecast
from seriescast.plans.models import TrainedModel
from seriescast.sources import registry
from seriescast.sources.bars import select_bars
from seriescast.sources.storage import materialize

HISTORY_DAYS = 3 * 365


def history_window(model: TrainedModel, as_of: dt.date | None = None) -> tuple[dt.date, dt.date]:
    """Dates ``[start, end)`` of the bars a forecast starts from, ending where training ended."""
    end = dt.date.fromisoformat(model.training_end) if model.training_end else as_of or dt.date.today()
    days = int((model.n_lags + 252) * 1.5) if model.kind == "xgb" else HISTORY_DAYS
    return end - dt.timedelta(days=days), end + dt.timedelta(days=1)


def forecast_requests(spark: SparkSession, folder: str, requests: DataFrame, bars: DataFrame, horizon: int,
                      calendar: str = "business") -> DataFrame:
    """``requests`` are ``(ticker, model_type)`` rows; each gets the forecast of its model.

    One forecast runs per stored model, over all the tickers that resolve to it.  Every
    request is answered: one without a model or without a forecast has one row with a
    ``reason`` and no step.
    """
    everything = materialize(resolve_models(requests, registry.registry(spark, folder)), "requests")
    resolved = everything.where("model_name IS NOT NULL")
    # a distinct list of stored models, not of tickers
    names = [r["model_name"] for r in resolved.select("model_name").distinct().orderBy("model_name").collect()]
    out = None
    for name in names:
        model = registry.load_model(spark, folder, name)
        start, end = history_window(model)
        tickers = resolved.where(F.col("model_name") == name).select("ticker", "resolution").distinct()
        # joined block by block, so that a huge series is not filtered in one task
        wanted = with_series_values(bars, tickers.select("ticker"))
        history = select_bars(wanted, None, start, end, volume="volume" in bars.columns)
        rows = forecast(model, history, horizon, calendar).withColumn("model_used", F.lit(name)).join(
            tickers, "ticker")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return with_reasons(everything, None, bars)
    return with_reasons(everything, materialize(out, "answers"), bars)


ANSWER = ("step int, ds date, prediction double, lower_bound double, upper_bound double")


def with_reasons(requests: DataFrame, answers: DataFrame | None, bars: DataFrame) -> DataFrame:
    """Answers, and a row with the reason for each request that got none.

    ``requests`` are resolved; a ticker is one row of a join, and long ones are counted before it.
    """
    asked = requests.select("ticker", "resolution", F.col("model_name").alias("model_used")).distinct()
    lengths = bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_bars"))
    open_ = asked if answers is None else asked.join(
        answers.select("ticker", "model_used").distinct(), ["ticker", "model_used"], "left_anti")
    reason = F.when(F.col("model_used").isNull(), "no model").when(F.col("n_bars").isNull(), "no bars").otherwise(
        F.concat(F.lit("too short for the model's features: "), F.col("n_bars"), F.lit(" bars")))
    blank = [F.lit(None).cast(kind).alias(name) for name, kind in (x.split() for x in ANSWER.split(", "))]
    none = open_.join(lengths, "ticker", "left").select("ticker", *blank, "model_used", "resolution", reason.alias("reason"))
    if answers is None:
        return none
    return answers.withColumn("reason", F.lit(None).cast("string")).unionByName(none)
