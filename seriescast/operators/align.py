"""Alignments: history with forecasts, actuals with predictions, requests with models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriescast.functions.calendar import future_dates
from seriescast.operators.layout import blocks, in_order, own_rows


MODEL_TYPES = ["rf", "xgb", "lstm", "prophet"]
#: Other names of the types; models are registered and requests resolved under the first.
TYPE_ALIASES = {"random_forest": "rf", "xgboost": "xgb", "seq": "lstm", "additive": "prophet"}


def model_type(name: str) -> str:
    return TYPE_ALIASES.get(name.lower(), name.lower())


def model_type_of(column: str) -> Column:
    lower = F.lower(column)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in TYPE_ALIASES.items() for x in pair]), lower), lower)


def align_history(history: DataFrame, forecast: DataFrame) -> DataFrame:
    """All dates of both sides, each side NULL where it has none."""
    return history.join(forecast, ["ticker", "ds"], "full_outer")


def residuals(actual: DataFrame, predicted: DataFrame) -> DataFrame:
    """``y - yhat`` on the dates both have."""
    return actual.join(predicted, ["ticker", "ds"]).withColumn(
        "residual", F.col("y") - F.col("yhat"))


def previous_price(bars: DataFrame, price: str = "close") -> DataFrame:
    """The price one row earlier in the full series, before any split is cut out."""
    return own_rows(blocks(bars, 1).withColumn("previous", F.lag(price).over(in_order()))).drop("blk")


def attach_regressors(frame: DataFrame, regressors: DataFrame, names: list[str]) -> DataFrame:
    return frame.join(regressors.select("ticker", "ds", *names), ["ticker", "ds"], "left")


def zero_filled(df: DataFrame, names: list[str]) -> DataFrame:
    """Expected columns that are absent become 0."""
    return df.withColumns({c: F.lit(0.0) for c in names if c not in df.columns})


def future_regressors(bars: DataFrame, names: list[str], horizon: int, calendar: str = "day") -> DataFrame:
    """Future dates with every regressor frozen at its last value, 0 where there is none."""
    present = [c for c in names if c in bars.columns]
    last = bars.groupBy("ticker").agg(
        F.max("ds").alias("last_ds"), F.max_by(F.struct("ds", *present), "ds").alias("_last"))
    dates = future_dates(last, horizon, calendar)
    values = last.select("ticker", *[F.col(f"_last.{c}").alias(c) for c in present])
    return zero_filled(dates.join(values, "ticker"), names).select("ticker", "step", "ds", *names)


def resolve_models(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """The model each request runs with.

    Its own ticker's model wins, then the generic one, then (unless the type is ``lstm``)
    any of its type.  The three choices are looked up by key from tables with one row per
    key, so a model type with many models or requests multiplies nothing.  Among several
    models of equal rank the newest is taken, then the first name.
    """
    pick = F.min(F.struct((-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("age"), "model_name"))["model_name"]
    known = registry.withColumn("model_type", model_type_of("model_type")).where(F.col("model_type").isin(MODEL_TYPES))
    requests = requests.withColumn("_type", model_type_of("model_type"))
    known = known.withColumnRenamed("model_type", "_type")
    own = known.where("ticker IS NOT NULL").groupBy("_type", "ticker").agg(pick.alias("_own"))
    by_type = known.groupBy("_type").agg(
        F.min(F.when(F.col("ticker").isNull(), F.struct(
            (-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("age"), "model_name")))["model_name"].alias("_generic"),
        pick.alias("_any"))
    fallback = F.when(F.col("_type") != "lstm", F.col("_any"))
    return (
        requests.join(own, ["_type", "ticker"], "left")
        # one row per known model type, so never more than len(MODEL_TYPES)
        .join(F.broadcast(by_type), "_type", "left")
        .select(*[c for c in requests.columns if c != "_type"],
                F.coalesce("_own", "_generic", fallback).alias("model_name"),
                F.when(F.col("_own").isNotNull(), "specific")
                .when(F.col("_generic").isNotNull(), "generic")
                .when(fallback.isNotNull(), "any").otherwise("none").alias("resolution"))
    )


def names_at(indices: Column, names: Column) -> Column:
    """Feature names for 0-based indices, with a note for one out of range."""
    return F.transform(indices, lambda i: F.coalesce(
        F.try_element_at(names, (i + 1).cast("int")),
        F.concat(F.lit("invalid index: "), i.cast("string"))))


def importance_map(names: Column, importances: Column) -> Column:
    """Name to importance, NULL unless both have the same length."""
    return F.when(F.size(names) == F.size(importances), F.map_from_arrays(names, importances))


def select_features(importances: DataFrame, threshold: str | float | None = "mean",
                    max_features: int | None = None) -> DataFrame:
    """Features of each ticker whose importance reaches the threshold, best first.

    ``threshold`` is ``mean``, ``median``, ``<factor>*mean``, a number or None (keep all).
    Input rows: ``ticker, idx, name, importance``; a ticker has at most a few hundred.
    """
    per_ticker = Window.partitionBy("ticker")
    if threshold is None:
        bound: Column = F.lit(float("-inf"))
    elif threshold == "median":
        bound = F.percentile("importance", 0.5).over(per_ticker)
    elif isinstance(threshold, str):
        factor = float(threshold.split("*")[0]) if "*" in threshold else 1.0
        bound = factor * F.avg("importance").over(per_ticker)
    else:
        bound = F.lit(float(threshold))
    rank = F.row_number().over(per_ticker.orderBy(F.desc("importance"), "idx"))
    kept = importances.withColumns({"_bound": bound, "rank": rank}).where(
        F.col("importance") >= F.col("_bound")).drop("_bound")
    return kept if max_features is None else kept.where(F.col("rank") <= max_features)


def compare_runs(runs: DataFrame, metric: str | None = None, page: int = 5) -> DataFrame:
    """One page of the comparison table: newest first, or best metric first, missing last."""
    order = [F.desc("ts")] if metric is None else [F.col(metric).asc_nulls_last()]
    return runs.orderBy(*order, "model_type", "ticker").limit(page)


def latest_run(runs: DataFrame, keys: list[str]) -> DataFrame:
    values = [c for c in runs.columns if c not in keys]
    return runs.groupBy(*keys).agg(F.max(F.struct("ts", *[c for c in values if c != "ts"])).alias("r")).select(
        *keys, *[F.col(f"r.{c}").alias(c) for c in values])
