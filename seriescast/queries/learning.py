"""Models: training, search, forecasts, storage.  Small settings, whole tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from seriescast.functions.text import parse_python, to_python
from seriescast.operators import metrics, split
from seriescast.plans import additive, recipes, report, search, service, shared
from seriescast.plans import forecast as fc
from seriescast.plans import training as T
from seriescast.plans.models import BoostParams, ForestParams
from seriescast.queries.registry import query
from seriescast.sources import fixtures as fx
from seriescast.sources import registry as store
from seriescast.sources.storage import fresh_path

FOREST = T.TrainConfig("rf", params=ForestParams(10, 5), helper_trees=5)
BOOST = T.TrainConfig("xgb", params=BoostParams(5, 3), helper_trees=3, select="median", max_features=None)
RETURNS = T.TrainConfig("seq", params=ForestParams(8, 4), sequence_length=3)
REGRESSORS = ["rsi", "price_to_ma"]


@query("rf_train_eval")
def rf_train_eval(spark, sf):
    return T.train(fx.bars(spark, sf), FOREST).metrics


@query("gbt_train_eval")
def gbt_train_eval(spark, sf):
    return T.train(fx.bars(spark, sf), BOOST).metrics


@query("seq_train_eval")
def seq_train_eval(spark, sf):
    return T.train(fx.bars(spark, sf), RETURNS).metrics


def additive_data(spark, sf):
    return recipes.features_additive(fx.bars(spark, sf))


@query("additive_train_eval")
def additive_train_eval(spark, sf):
    return additive.train(additive_data(spark, sf), REGRESSORS)[1]


@query("additive_forecast")
def additive_forecast(spark, sf):
    frame = additive_data(spark, sf)
    return additive.forecast(additive.fit(frame, additive.AdditiveParams(), REGRESSORS), frame, 10)


@query("additive_search")
def additive_search(spark, sf):
    space = {"changepoint_prior_scale": [0.01, 0.5], "seasonality_mode": ["additive", "multiplicative"]}
    return additive.search(additive_data(spark, sf), additive.grid(space), REGRESSORS).drop("params")


@query("trend_slope", """
WITH bars AS (SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS ds, arg_max(o_totalprice, o_orderkey) AS close
              FROM orders GROUP BY 1, 2),
x AS (SELECT ticker, close, CAST(ds - min(ds) OVER (PARTITION BY ticker) AS DOUBLE) AS t FROM bars)
SELECT ticker, (round(regr_slope(close, t), 6) + 0.0) AS slope, (round(regr_intercept(close, t), 3) + 0.0) AS intercept
FROM x GROUP BY 1""")
def trend_slope(spark, sf):
    """The additive model reduced to its straight line."""
    frame = split.index_series(fx.bars(spark, sf)).select("ticker", "ds", "pos", "n_rows", F.col("close").alias("y"))
    line = additive.AdditiveParams(changepoints=0, yearly=False, weekly=False)
    solved = additive.solve(additive.gram(additive.parts(frame), line, [], ["ticker"]), [[0.0, 0.0]])
    return solved.select(
        "ticker", F.round(F.col("_beta")[1] * F.col("_scale") / F.col("_span"), 6).alias("slope"),
        F.round(F.col("_beta")[0] * F.col("_scale"), 3).alias("intercept"))


@query("rf_forecast")
def rf_forecast(spark, sf):
    bars = fx.bars(spark, sf)
    return fc.forecast(T.train(bars, FOREST).model, bars, 2)


@query("gbt_forecast")
def gbt_forecast(spark, sf):
    bars = fx.bars(spark, sf)
    result = T.train(bars, BOOST)
    return fc.with_residual_bounds(fc.forecast(result.model, bars, 2), result.residuals)


@query("return_forecast")
def return_forecast(spark, sf):
    bars = fx.bars(spark, sf)
    return fc.forecast(T.train(bars, RETURNS).model, bars, 2)


@query("direct_forecast_frame")
def direct_forecast_frame(spark, sf):
    frame = recipes.features_rf(fx.bars(spark, sf)).select("ticker", "ds", "pos", "n_rows", "close", "rsi", "sma_20")
    direct = fc.direct_frame(frame, "close", 5, ["rsi", "sma_20"])
    return direct.groupBy("ticker", "step").agg(F.count(F.lit(1)).alias("n"), F.avg("rsi").alias("rsi"))


@query("rf_search")
def rf_search(spark, sf):
    """24 candidates on 3 folds by shared fits: 2 forests a fold (one per max_features), cut to 3 depths and 2 counts."""
    space = {"select_max_features": [5], "n_estimators": [5, 10], "max_depth": [3, 5, None], "min_samples_split": [2, 5],
             "min_samples_leaf": [3], "max_features": ["sqrt", "0.5"]}
    board, _ = shared.shared_search(fx.bars(spark, sf), FOREST, search.grid(space), folds=3)
    return board


@query("gbt_search")
def gbt_search(spark, sf):
    """8 grid points on 3 folds by shared fits: 4 boosted models a fold, each scored at 3 and 6 rounds."""
    space = {"select_threshold": ["median"], "n_estimators": [3, 6], "max_depth": [2, 3], "learning_rate": [0.1, 0.3]}
    board, _ = shared.shared_search(fx.bars(spark, sf), BOOST, search.grid(space), folds=3)
    return board


@query("importance_select")
def importance_select(spark, sf):
    model = T.train(fx.bars(spark, sf), FOREST).model
    return spark.createDataFrame([(i, n) for i, n in zip(model.params["features_index"], model.selected)],
                                 "idx int, name string")


@query("feature_importance")
def feature_importance(spark, sf):
    return T.train(fx.bars(spark, sf), FOREST).importances


@query("rf_interval")
def rf_interval(spark, sf):
    """Interval over the trees for every test row."""
    bars = fx.bars(spark, sf)
    model = T.train(bars, FOREST).model
    frame, _ = T.prepared(bars, FOREST)
    drawn = model.draws(split.split_two(frame, FOREST.ratio).where("split = 'test'"))
    return drawn.select("ticker", "ds", *[c.alias(n) for n, c in metrics.draws_interval(F.col("draws")).items()])


@query("train_report_json")
def train_report_json(spark, sf):
    return report.train_report(T.train(fx.bars(spark, sf), FOREST))


@query("train_report")
def train_report(spark, sf):
    result = T.train(fx.bars(spark, sf), FOREST)
    return metrics.residual_summary(result.residuals, ["ticker"]).join(
        result.acf.groupBy("ticker").agg(F.count(F.lit(1)).alias("acf_lags")), "ticker").join(
        result.metrics.select("ticker", "rmse", "mape"), "ticker").withColumn(
        "band", metrics.error_band(F.col("mape")))


def saved(spark, sf):
    folder = fresh_path(spark, "store")
    bars = fx.bars(spark, sf)
    model = T.train(bars, BOOST).model
    store.save_model(model, folder, "xgb_model_generic", None, dt.datetime(2024, 1, 1))
    return folder, bars, model


@query("model_save", """
SELECT 'xgb_model_generic' AS model_name, 'xgb' AS model_type, CAST(NULL AS VARCHAR) AS ticker, true AS has_features,
       true AS has_rmse, max(CAST(o_orderdate AS DATE)) AS training_end_date FROM orders""")
def model_save(spark, sf):
    folder, _, _ = saved(spark, sf)
    return store.registry(spark, folder).select(
        "model_name", "model_type", "ticker", (F.size("feature_importances") > 0).alias("has_features"),
        F.map_contains_key("metrics", "RMSE").alias("has_rmse"), "training_end_date")


@query("model_roundtrip", """
SELECT ticker, count(*) - 15 AS n, CAST(0 AS BIGINT) AS n_changed FROM (
  SELECT DISTINCT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS ds FROM orders) d GROUP BY 1""")
def model_roundtrip(spark, sf):
    """Rows whose prediction by the stored model differs from the one in memory."""
    folder, bars, model = saved(spark, sf)
    loaded = store.load_model(spark, folder, "xgb_model_generic")
    frame, _ = T.prepared(bars, BOOST)
    a = model.score(frame).select("ticker", "ds", F.col("yhat").alias("before"))
    b = loaded.score(frame).select("ticker", "ds", F.col("yhat").alias("after"))
    return a.join(b, ["ticker", "ds"]).groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("before") != F.col("after")).alias("n_changed"))


@query("registry_list", """
SELECT 'xgb_model_generic' AS model_name, 'xgb' AS model_type, true AS stored, true AS sized,
       max(CAST(o_orderdate AS DATE)) AS training_end_date, DATE '2024-01-03' AS created FROM orders""")
def registry_list(spark, sf):
    """A model saved twice is listed once, by its newest row."""
    folder, _, model = saved(spark, sf)
    store.save_model(model, folder, "xgb_model_generic", None, dt.datetime(2024, 1, 3))
    listed = store.list_models(spark, folder)
    return listed.select("model_name", "model_type", (F.col("size_bytes") > 0).alias("stored"),
                         (F.col("size_mb") > 0).alias("sized"), "training_end_date", F.to_date("created_at").alias("created"))


@query("forecast_job", """
WITH b AS (SELECT DISTINCT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS d FROM orders),
l AS (SELECT ticker, max(d) AS d, count(*) AS n, count(*) FILTER (d >= (SELECT max(d) FROM b) - 400) > 65 AS enough
      FROM b GROUP BY 1)
SELECT ticker, CASE WHEN enough THEN CAST(1 AS INTEGER) END AS step,
       CASE WHEN enough THEN CAST(d + CASE isodow(d) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS DATE) END AS ds,
       CASE WHEN ticker = '1-URGENT' THEN 'xgb_model_URGENT' ELSE 'xgb_model_generic' END AS model_used,
       CASE WHEN ticker = '1-URGENT' THEN 'specific' ELSE 'generic' END AS resolution,
       CASE WHEN NOT enough THEN 'too short for the model''s features: ' || n || ' bars' END AS reason,
       CASE WHEN enough THEN true END AS ordered FROM l
UNION ALL SELECT 'NOBARS', NULL, NULL, 'xgb_model_generic', 'generic', 'no bars', NULL
UNION ALL SELECT 'NOMODEL', NULL, NULL, NULL, 'none', 'no model', NULL""")
def forecast_job(spark, sf):
    """Requests resolved to stored models and forecast from the window each model needs; all are answered."""
    folder, bars, model = saved(spark, sf)
    store.save_model(model, folder, "xgb_model_URGENT", "1-URGENT", dt.datetime(2024, 1, 2))
    wanted = bars.select("ticker", F.lit("xgboost").alias("model_type")).distinct().unionByName(
        spark.createDataFrame([("NOBARS", "xgb"), ("NOMODEL", "rf")], "ticker string, model_type string"))
    rows = service.forecast_requests(spark, folder, wanted, bars, 1)
    return rows.select("ticker", "step", "ds", "model_used", "resolution", "reason",
                       F.expr("lower_bound <= prediction AND prediction <= upper_bound").alias("ordered"))


@query("evaluate_saved")
def evaluate_saved(spark, sf):
    folder, bars, _ = saved(spark, sf)
    loaded = store.load_model(spark, folder, "xgb_model_generic")
    scores, samples = T.evaluate_saved(loaded, bars, BOOST)
    return samples.join(scores.select("ticker", "rmse", "r2"), "ticker")


@query("metadata_parse")
def metadata_parse(spark, sf):
    """Parameters written as Python text next to a model and read back typed."""
    model = T.train(fx.bars(spark, sf), BOOST).model
    text = spark.createDataFrame([(to_python({k: v for k, v in model.params.items()}),)], "best_params string")
    schema = "n_estimators int, max_depth int, learning_rate double, subsample double, features_index array<int>"
    return text.select(F.inline(F.array(parse_python(F.col("best_params"), schema))))
