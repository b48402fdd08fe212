import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriescast.functions.calendar import future_dates
from seriescast.functions.text import parse_python, ticker_from_name
from seriescast.operators import align, diagnostics, metrics, scale, split
from seriescast.operators.layout import index_series
from seriescast.operators.quantiles import exact_quantiles
from seriescast.sources import bars as B


def test_exact_quantiles_with_a_hot_value(spark):
    rng = np.random.default_rng(3)
    groups = {"a": np.r_[rng.normal(size=900), np.full(500, 0.25)], "b": rng.integers(0, 5, 300).astype(float),
              "c": np.array([2.0]), "d": np.array([1.0, 2.0, 3.0, 4.0])}
    pdf = pd.concat([pd.DataFrame({"k": k, "v": v}) for k, v in groups.items()])
    probs = [0.0, 0.025, 0.25, 0.5, 0.75, 0.975, 1.0]
    got = {r["k"]: r["q"] for r in exact_quantiles(
        spark.createDataFrame(pdf, "k string, v double"), ["k"], "v", probs, slices=8).collect()}
    for k, v in groups.items():
        np.testing.assert_allclose(got[k], np.percentile(v, [100 * p for p in probs]), rtol=1e-12)


@pytest.mark.parametrize("kind", scale.KINDS)
def test_scalers_fit_train_rows_and_invert(bars, kind):
    df, pdf = bars
    frame = index_series(df).withColumn("flat", F.lit(3.0))
    train = frame.where("pos < floor(n_rows * 0.8)")
    params = scale.fit(train, ["close", "flat"], kind)
    got = scale.apply(frame, params, ["close", "flat"], suffix="_s")
    back = scale.invert(got, params, {"close_s": "close"}).where("ticker = 'G300'").orderBy("ds").toPandas()
    np.testing.assert_allclose(back["close_s"], back["close"], rtol=1e-9)
    out = got.where("ticker = 'G300'").orderBy("ds").toPandas()
    head = out["close"][:240]
    center, spread = {
        "minmax": (head.min(), head.max() - head.min()), "standard": (head.mean(), head.std(ddof=0)),
        "robust": (head.median(), head.quantile(0.75) - head.quantile(0.25))}[kind]
    np.testing.assert_allclose(out["close_s"], (out["close"] - center) / spread, rtol=1e-9, atol=1e-12)
    assert (out["flat_s"] == 0).all()


def test_folds_cover_the_tail(bars):
    df, _ = bars
    folds = split.ts_folds(df.where("ticker = 'G300'"), 5)
    got = folds.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("hi")).toPandas()
    tests = got[got["role"] == "test"].sort_values("fold")
    assert list(tests["n"]) == [50] * 5 and list(tests["hi"]) == [99, 149, 199, 249, 299]
    trains = got[got["role"] == "train"].sort_values("fold")
    assert list(trains["n"]) == [50, 100, 150, 200, 250]


def test_sequences_restart_in_each_split(bars):
    df, pdf = bars
    parts = split.split_three(df.where("ticker = 'G300'"))
    got = split.sequences(parts, ["close"], "close", 4, split.split_start(), block=64).orderBy("ds").toPandas()
    assert len(got) == 300 - 3 * 4
    close = pdf[pdf["ticker"] == "G300"]["close"].to_numpy()
    np.testing.assert_array_equal([x[0] for x in got["sequence"][0]], close[:4])
    assert got["label"][0] == close[4]


def sample_acf(x, k):
    c = x - x.mean()
    return (c[k:] * c[: len(c) - k]).sum() / (c * c).sum()


def test_acf_and_pacf(spark, bars):
    df, pdf = bars
    x = pdf[pdf["ticker"] == "G300"]["close"].diff().fillna(0).to_numpy()
    days = pd.date_range("2020-01-01", periods=300).date
    rows = spark.createDataFrame(pd.DataFrame({"ticker": "T", "ds": days, "residual": x}),
                                 "ticker string, ds date, residual double")
    a = diagnostics.acf(rows, lags=10, block=64).orderBy("lag").toPandas()
    want = np.array([sample_acf(x, k) for k in range(11)])
    np.testing.assert_allclose(a["value"], want, atol=1e-12)
    assert a["lower"][0] == a["upper"][0] == 1
    np.testing.assert_allclose(a["upper"][3] - a["value"][3],
                               1.959964 * np.sqrt((1 + 2 * (want[1:3] ** 2).sum()) / 300), rtol=1e-6)
    for adjusted in (True, False):
        p = diagnostics.pacf(rows, lags=10, adjusted=adjusted, block=64).orderBy("lag").toPandas()
        n = 300
        r = want * [n / (n - k) if adjusted else 1.0 for k in range(11)]
        for k in range(1, 11):
            toeplitz = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
            assert p["value"][k] == pytest.approx(np.linalg.solve(toeplitz, r[1:k + 1])[-1], abs=1e-9)


def test_lag_clamp_on_short_series(spark, bars):
    df, _ = bars
    a = diagnostics.acf(df.where("ticker = 'D19'").withColumn("residual", F.col("close")), clamp=True)
    assert a.count() == 19 // 2


def test_metrics(spark):
    rows = spark.createDataFrame([("T", 1.0, 2.0), ("T", 4.0, 2.0), ("T", 0.0, 0.0)], "ticker string, y double, yhat double")
    m = metrics.regression_metrics(rows, ["ticker"]).first()
    assert m["mse"] == pytest.approx(5 / 3) and m["mae"] == 1 and m["mape"] == pytest.approx(0.5)
    assert metrics.r_squared(rows, ["ticker"]).first()["r2"] == pytest.approx(1 - 5 / (26 / 3))


def test_error_bands(spark):
    df = spark.createDataFrame([(0.01,), (0.05,), (0.12,), (0.2,)], "m double")
    got = [r[0] for r in df.orderBy("m").select(metrics.error_band(F.col("m"))).collect()]
    assert got == ["success", "processing", "warning", "error"]


def test_range_resolution():
    assert B.resolve_range("2021-01-01", "2022-01-01") == (dt.date(2021, 1, 1), dt.date(2022, 1, 1))
    assert B.resolve_range(period="3_years", as_of="2024-01-01")[0] == dt.date(2024, 1, 1) - dt.timedelta(1095)
    assert B.resolve_range(period="7_years", as_of="2024-01-01")[0] == dt.date(2020, 12, 10)
    assert B.resolve_range(as_of="2024-01-01", default_end="2023-01-01")[1] == dt.date(2023, 1, 1)
    with pytest.raises(ValueError, match="after end"):
        B.resolve_range("2022-01-02", "2022-01-01")
    with pytest.raises(ValueError, match="YYYY-MM-DD"):
        B.resolve_range("2022/01/02", "2022-01-01")
    assert B.resolve_calendar_range(None, None, "1_year", "2024-02-29")[0] == dt.date(2023, 3, 1)
    assert B.resolve_calendar_range("2020-01-01", "2020-02-01", "1_year", "2024-02-29")[0] == dt.date(2020, 1, 1)
    assert B.default_range(None, None, "2024-01-01") == (dt.date(2021, 1, 1), dt.date(2024, 1, 1))


def test_eligibility_and_missing(spark, bars):
    df, _ = bars
    rows = {r["ticker"]: r for r in B.eligible_series(df, 252, 21).collect()}
    assert rows["G300"]["can_train"] and not rows["F70"]["can_train"] and rows["F70"]["can_predict"]
    assert rows["F70"]["reason"] == "has 70 rows, needs 252"
    wanted = spark.createDataFrame([("G300",), ("ZZZ",)], "ticker string")
    assert [r["ticker"] for r in B.missing_tickers(wanted, df).collect()] == ["ZZZ"]


def test_invalid_values(spark):
    df = spark.createDataFrame([(1.0, None), (float("inf"), 2.0), (float("nan"), 3.0)], "a double, b double")
    got = {r["column_name"]: (r["n_null"], r["n_inf"]) for r in B.invalid_columns(df, ["a", "b"]).collect()}
    assert got == {"a": (1, 1), "b": (1, 0)}
    assert B.invalid_rows(df, ["a", "b"]).count() == 3


def test_future_dates(spark):
    last = spark.createDataFrame([("T", dt.date(2024, 5, 31))], "ticker string, last_ds date")
    days = [r["ds"] for r in future_dates(last, 6).orderBy("step").collect()]
    assert days == [dt.date(2024, 6, d) for d in (3, 4, 5, 6, 7, 10)]
    assert [r["ds"] for r in future_dates(last, 2, "day").orderBy("step").collect()] == [
        dt.date(2024, 6, 1), dt.date(2024, 6, 2)]


NAMES = {"lstm_model_AAPL": "AAPL", "rf_model_AAPL.joblib": "AAPL", "xgb_model_TSLA.pkl": "TSLA",
         "model_MSFT_20231201.h5": "MSFT", "lstm_model_generic": "LSTM", "lstm_model_NU": "NU", "LSTM": "LSTM",
         "lstm_model": "LSTM", "lstm_model_GOOGL": "GOOGL", "xgb_model_TSLA": "XGB", "12345": None}


def test_ticker_names(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "name string")
    got = {r[0]: r[1] for r in df.select("name", ticker_from_name(F.col("name"))).collect()}
    assert got == NAMES


def test_python_literals(spark):
    text = "{'rf__max_depth': 3, 'flag': True, 'none': None, 'pair': (1, 2)}"
    df = spark.createDataFrame([(text,), ("not a dict",)], "t string")
    schema = "rf__max_depth int, flag boolean, none string, pair array<int>"
    got = [r[0] for r in df.select(parse_python(F.col("t"), schema)).collect()]
    assert got[0].asDict() == {"rf__max_depth": 3, "flag": True, "none": None, "pair": [1, 2]}
    assert got[1] is None or got[1]["rf__max_depth"] is None


def test_feature_choice(spark):
    rows = [("T", i, f"f{i}", v) for i, v in enumerate([0.5, 0.1, 0.3, 0.1])]
    df = spark.createDataFrame(rows, "ticker string, idx int, name string, importance double")

    def kept(*a):
        return [r["name"] for r in align.select_features(df, *a).orderBy("rank").collect()]

    assert kept("mean") == ["f0", "f2"]
    assert kept("median") == ["f0", "f2"] and kept("1.25*mean") == ["f0"]
    assert kept(None, 3) == ["f0", "f2", "f1"] and kept(0.1, 2) == ["f0", "f2"]


def test_names_for_indices(spark):
    df = spark.createDataFrame([([0, 2, 9], ["a", "b", "c"])], "i array<int>, n array<string>")
    assert df.select(align.names_at(F.col("i"), F.col("n"))).first()[0] == ["a", "c", "invalid index: 9"]
    assert df.select(align.importance_map(F.col("n"), F.array(F.lit(1.0)))).first()[0] is None


def test_zero_filled(spark):
    df = spark.createDataFrame([(1.0,)], "a double")
    assert align.zero_filled(df, ["a", "b"]).first().asDict() == {"a": 1.0, "b": 0.0}
