"""Training, scoring, forecasting and storing models on a small panel."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from conftest import BARS_DDL, make_bars
from pyspark.sql import functions as F

from seriescast.operators.split import last_row
from seriescast.plans import additive, recipes, report, search
from seriescast.plans import forecast as fc
from seriescast.plans import training as T
from seriescast.plans.models import BoostParams, ForestParams, choose
from seriescast.sources import registry

CONFIGS = {
    "rf": T.TrainConfig("rf", params=ForestParams(6, 4), helper_trees=4),
    "xgb": T.TrainConfig("xgb", params=BoostParams(4, 2), helper_trees=2, select="median", max_features=None),
    "seq": T.TrainConfig("seq", params=ForestParams(5, 3), sequence_length=3),
}


@pytest.fixture(scope="module")
def panel(spark):
    pdf = make_bars({"AAA": 300, "BBB": 340, "CCC": 40})
    return spark.createDataFrame(pdf, BARS_DDL).cache()


@pytest.fixture(scope="module")
def trained(panel):
    return {kind: T.train(panel, cfg) for kind, cfg in CONFIGS.items()}


@pytest.mark.parametrize("kind", CONFIGS)
def test_training(trained, kind):
    result = trained[kind]
    scores = {r["ticker"]: r for r in result.metrics.collect()}
    assert set(scores) == {"AAA", "BBB"}  # CCC is too short
    assert all(np.isfinite(r["rmse"]) for r in scores.values())
    first = result.acf.where("lag = 0").first()
    assert first["value"] == pytest.approx(1) and first["lower"] == pytest.approx(1)
    assert result.importances.count() == len(result.model.selected)
    assert result.model.metrics["RMSE"] == pytest.approx(result.model.metrics["MSE"] ** 0.5)


def test_held_out_rows_do_not_move_the_scaler(panel, trained):
    scaler = trained["rf"].model.scaler.where("ticker = 'AAA'").first()
    frame, _ = T.prepared(panel, CONFIGS["rf"])
    head = frame.where("ticker = 'AAA' AND pos < floor(n_rows * 0.8)").agg(F.min("close"), F.max("close")).first()
    assert scaler["_center_label"] == head[0] and scaler["_spread_label"] == pytest.approx(head[1] - head[0])


@pytest.mark.parametrize("kind", CONFIGS)
def test_tail_features_equal_full_features(panel, trained, kind):
    """What a forecast derives from a tail is what the recipe derives from the whole history."""
    model = trained[kind].model
    tails, constants = fc.start_state(panel, model)
    last = fc._features(tails.join(constants, "ticker"), model).where("pos = n_rows - 1 AND ticker <> 'CCC'")
    got = last.select("ticker", *model.names).toPandas().set_index("ticker").sort_index()
    full = last_row(recipes.recipe(kind).build(panel, n_lags=model.n_lags)).where("ticker <> 'CCC'")
    want = full.select("ticker", *model.names).toPandas().set_index("ticker").sort_index()
    assert list(got.index) == list(want.index)
    np.testing.assert_allclose(got.astype(float), want.astype(float), rtol=1e-7, atol=1e-9)


@pytest.mark.parametrize("kind", CONFIGS)
def test_forecast(panel, trained, kind):
    rows = fc.forecast(trained[kind].model, panel, 3).toPandas()
    assert set(rows["ticker"]) == {"AAA", "BBB"}
    assert (rows.groupby("ticker").size() == 3).all()
    assert (rows["lower_bound"] <= rows["upper_bound"]).all() and rows["prediction"].notna().all()
    assert all(d.weekday() < 5 for d in rows["ds"])
    ahead = rows.sort_values(["ticker", "step"]).groupby("ticker")["ds"]
    assert ahead.apply(lambda s: s.is_monotonic_increasing).all()


def test_bar_rules(spark):
    row = spark.createDataFrame([(10.0, 12.0, 9.0, 11.0, 15.0, 1, 0.1)],
                                "open double, high double, low double, close double, prediction double, green_day int, daily_range double")

    def bar(rule):
        return row.select(*[c.alias(n) for n, c in rule().items()]).first().asDict()

    assert bar(fc.clamped_bar) == {"open": 11.0, "high": 13.0, "low": 10.0, "green_day": 1}
    assert bar(fc.spread_bar) == {"open": 11.0, "high": pytest.approx(15.15), "low": 11.0, "green_day": 1}
    assert bar(fc.volatile_bar) == {"open": 11.0, "high": pytest.approx(16.5), "low": pytest.approx(13.5), "green_day": 1}


def test_residual_bounds(spark):
    rows = spark.createDataFrame([("T", 10.0, 10.0, 10.0)], "ticker string, prediction double, lower_bound double, upper_bound double")
    residuals = spark.createDataFrame([("T", float(v)) for v in range(-20, 21)], "ticker string, residual double")
    got = fc.with_residual_bounds(rows, residuals).first()
    assert got["lower_bound"] == pytest.approx(-9) and got["upper_bound"] == pytest.approx(29)


def test_trees_average_to_the_forest(panel, trained):
    model = trained["rf"].model
    frame, _ = T.prepared(panel, CONFIGS["rf"])
    rows = frame.where("ticker = 'AAA' AND pos > 200")
    a = model.score(rows).select("ds", "yhat").toPandas().set_index("ds").sort_index()
    b = model.draws(rows).select("ds", F.aggregate(
        "draws", F.lit(0.0), lambda s, v: s + v, lambda s: s / 6).alias("m")).toPandas().set_index("ds").sort_index()
    np.testing.assert_allclose(a["yhat"], b["m"], rtol=1e-9)


def test_store_and_load(spark, panel, trained, tmp_path):
    model = trained["rf"].model
    folder = str(tmp_path)
    registry.save_model(model, folder, "rf_model_AAA", "AAA", dt.datetime(2024, 1, 1))
    loaded = registry.load_model(spark, folder, "rf_model_AAA")
    assert loaded.names == model.names and loaded.selected == model.selected and loaded.params == model.params
    row = registry.list_models(spark, folder).first()
    assert row["size_bytes"] > 0 and row["best_params"]["n_estimators"] == "6" and row["ticker"] == "AAA"
    frame, _ = T.prepared(panel, CONFIGS["rf"])
    a, b = (m.score(frame).orderBy("ticker", "ds").toPandas()["yhat"] for m in (model, loaded))
    np.testing.assert_array_equal(a, b)
    scores, samples = T.evaluate_saved(loaded, panel, CONFIGS["rf"])
    assert samples.count() == 10 and scores.count() == 2


def test_scoring_longer_history_loses_no_rows(spark, panel, trained):
    """A model scores rows far beyond the length it was trained on."""
    model = trained["rf"].model
    frame, _ = T.prepared(panel, CONFIGS["rf"])
    late = frame.where("ticker = 'AAA'").withColumns({"pos": F.col("pos") + 10_000, "n_rows": F.col("n_rows") + 10_000})
    assert model.score(late).count() == frame.where("ticker = 'AAA'").count()


def test_next_day_label(panel):
    frame, _ = T.prepared(panel, T.TrainConfig("rf", target_mode="next_day"))
    rows = frame.where("ticker = 'AAA'").orderBy("pos").toPandas()
    assert list(rows["label"][:-1]) == list(rows["close"][1:])
    assert set(rows["n_rows"]) == {len(rows)}


def test_grids():
    assert search.grid_size(search.FOREST_SPACE) == 864 and search.grid_size(search.BOOST_SPACE) == 216
    assert search.grid_size(search.WIDE_BOOST_SPACE) == 729 and len(additive.grid()) == 160
    drawn = search.sample(search.FOREST_SPACE, 300)
    assert len({repr(c) for c in drawn}) == 300 and drawn == search.sample(search.FOREST_SPACE, 300)


def test_choice_of_features():
    ranked = [(0, "a", 0.5), (1, "b", 0.1), (2, "c", 0.4)]
    assert choose(ranked, "mean", 15) == [0, 2] and choose(ranked, "mean", 1) == [0]
    assert choose(ranked, None, None) == [0, 1, 2] and choose(ranked, 0.9, 5) == [0]


def test_search_and_refit(panel):
    cfg = CONFIGS["xgb"]
    board, best = search.search(panel, cfg, search.grid({"n_estimators": [2], "max_depth": [1, 3]}), folds=2)
    rows = board.orderBy("rank").collect()
    assert [r["n_folds"] for r in rows] == [2, 2] and rows[0]["mean_mse"] <= rows[1]["mean_mse"]
    assert search.best_config(cfg, best).params.max_depth == best["max_depth"]


def test_direct_frame(panel):
    frame = recipes.features_rf(panel).select("ticker", "ds", "pos", "n_rows", "close", "rsi")
    rows = fc.direct_frame(frame.where("ticker = 'AAA'"), "close", 3, ["rsi"]).toPandas()
    n = frame.where("ticker = 'AAA'").count()
    assert list(rows.groupby("step").size()) == [n - 1, n - 2, n - 3]


def additive_frame(spark, n=500):
    days = pd.date_range("2020-01-01", periods=n)
    t = np.arange(n)
    y = 50 + 0.05 * t + 3 * np.sin(2 * np.pi * t / 7) + np.where(t > 200, 0.1 * (t - 200), 0)
    pdf = pd.DataFrame({"ticker": "T", "ds": days.date, "y": y})
    return spark.createDataFrame(pdf, "ticker string, ds date, y double"), y


def test_additive_model_follows_trend_and_season(spark):
    df, y = additive_frame(spark)
    params = additive.AdditiveParams(changepoint_prior_scale=0.5)
    model = additive.fit(df.where("ds < '2021-04-01'"), params, [])
    rows = model.predict(df).orderBy("ds").toPandas()
    assert np.abs(rows["yhat"] - y)[:450].max() < 0.5
    assert (rows["yhat_lower"] <= rows["yhat_upper"]).all()
    ahead = additive.forecast(model, df, 5).orderBy("step").toPandas()
    assert list(ahead["step"]) == [1, 2, 3, 4, 5] and ahead["prediction"].notna().all()


def test_additive_gram_equals_dense_least_squares(spark):
    df, y = additive_frame(spark, 120)
    params = additive.AdditiveParams(changepoints=3, yearly=False)
    grams = additive.gram(additive.parts(df), params, [], ["ticker"])
    beta = np.array(additive.solve(grams, [[0.0] * 11]).first()["_beta"])
    stats = additive.series_stats(df, params, [], ["ticker"])
    x = np.array([r[0] for r in df.join(stats, "ticker").orderBy("ds").select(additive.design(params, [])).collect()])
    want = np.linalg.lstsq(x, y / np.abs(y).max(), rcond=None)[0]
    np.testing.assert_allclose(x @ beta, x @ want, atol=1e-8)


def test_multiplicative_mode(spark):
    df, y = additive_frame(spark)
    model = additive.fit(df, additive.AdditiveParams(seasonality_mode="multiplicative"), [])
    rows = model.predict(df).orderBy("ds").toPandas()
    assert np.abs(rows["yhat"] / y - 1).mean() < 0.05


def test_additive_search_ranks_candidates(spark):
    df, _ = additive_frame(spark, 800)
    candidates = additive.grid({"changepoint_prior_scale": [0.001, 0.5], "seasonality_mode": ["additive"]})
    board = additive.search(df, candidates, []).orderBy("rank").collect()
    assert len(board) == 2 and board[0]["rmse"] <= board[1]["rmse"] and board[0]["candidate"] == 1


def test_train_report_is_json(trained):
    row = report.train_report(trained["rf"]).orderBy("ticker").first()
    import json

    doc = json.loads(row["report"])
    assert doc["ticker"] == "AAA" and len(doc["acf"]["values"]) == 41 and doc["metrics"]["RMSE"] > 0
    assert doc["best_params"]["n_estimators"] == "6" and "close_lag_1" in doc["features_names"]


def test_export_has_four_decimals(spark, panel, tmp_path):
    report.export_csv(report.naive_forecast(panel, 2), str(tmp_path / "csv"))
    rows = spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()
    assert len(rows) == 6 and all(len(r["Prediccion"].split(".")[1]) == 4 for r in rows)


def test_early_stopping_builds_fewer_trees(panel):
    params = BoostParams(30, 2, learning_rate=1.0)
    cfg = T.TrainConfig("xgb", params=params, select=None, max_features=None, early_stopping=0.2)
    assert T.train(panel, cfg).model.regressor.getNumTrees < 30


def test_history_window(trained):
    from seriescast.plans.service import history_window

    start, end = history_window(trained["xgb"].model)
    assert (end - start).days == int((15 + 252) * 1.5) + 1
    assert str(end - dt.timedelta(days=1)) == trained["xgb"].model.training_end
    start, end = history_window(trained["rf"].model)
    assert (end - start).days == 3 * 365 + 1


def test_additive_training_and_storage(spark, tmp_path):
    df, _ = additive_frame(spark)
    model, scores = additive.train(df, [])
    assert np.isfinite(scores.first()["rmse"])
    model.save(str(tmp_path))
    again = additive.AdditiveModel.load(spark, str(tmp_path))
    a, b = (m.predict(df).orderBy("ds").toPandas()["yhat"] for m in (model, again))
    np.testing.assert_array_equal(a, b)


def test_store_lists_each_model_once(spark, tmp_path):
    from seriescast.sources import registry as store

    folder = str(tmp_path)
    assert store.registry(spark, folder).collect() == [] == store.list_models(spark, folder).collect()
    day = dt.datetime(2024, 1, 1)
    rows = [("m", "lstm", None, {}, None, {}, day + dt.timedelta(days=k), None) for k in range(3)]
    for row in rows:
        spark.createDataFrame([row], store.SCHEMA).write.mode("append").parquet(f"{folder}/registry")
    only = store.registry(spark, folder).collect()
    assert [(r.model_name, r.created_at) for r in only] == [("m", rows[2][6])]


def test_type_names_resolve_alike(spark):
    from seriescast.operators.align import resolve_models

    stored = spark.createDataFrame([("s", "seq", None), ("a", "additive", "X"), ("r", "rf", None)],
                                   "model_name string, model_type string, ticker string").withColumn(
        "created_at", F.lit("2024-01-01").cast("timestamp"))
    asked = spark.createDataFrame([("X", t) for t in ("seq", "lstm", "additive", "prophet", "random_forest", "nope")],
                                  "ticker string, model_type string")
    got = {r.model_type: (r.model_name, r.resolution) for r in resolve_models(asked, stored).collect()}
    assert got == {"seq": ("s", "generic"), "lstm": ("s", "generic"), "additive": ("a", "specific"),
                   "prophet": ("a", "specific"), "random_forest": ("r", "generic"), "nope": (None, "none")}


def test_every_request_has_an_answer(spark):
    from seriescast.plans import service

    asked = spark.createDataFrame([("A", "m", "generic"), ("B", "m", "generic"), ("C", None, "none"), ("D", "m", "generic")],
                                  "ticker string, model_name string, resolution string")
    bars = spark.createDataFrame([("A",), ("B",), ("B",)], "ticker string")
    answers = spark.createDataFrame([("A", 1, None, 1.0, 1.0, 1.0, "m", "generic")],
                                    f"ticker string, {service.ANSWER}, model_used string, resolution string")
    got = {r.ticker: (r.step, r.reason) for r in service.with_reasons(asked, answers, bars).collect()}
    assert got == {"A": (1, None), "B": (None, "too short for the model's features: 2 bars"),
                   "C": (None, "no model"), "D": (None, "no bars")}


@pytest.mark.parametrize("master, local", [("local", True), ("local[8]", True), ("local-cluster[2,1,1024]", False),
                                           ("yarn", False), ("spark://host:7077", False)])
def test_only_one_process_shares_a_local_folder(master, local):
    from seriescast.sources.storage import is_local

    assert is_local(master) is local
