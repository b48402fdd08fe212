"""Recipes against pandas formulas written out independently, on series of every length."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriescast.plans import recipes as R


def roll(s, k):
    return s.rolling(k, min_periods=1)


def rsi(close):
    d = close.diff().fillna(0)
    return 100 - 100 / (1 + roll(d.clip(lower=0), 14).mean() / (roll(-d.clip(upper=0), 14).mean() + 1e-10))


def base(g):
    n, c, out = len(g), g["close"], g.copy()
    for k in (5, 10, 20, 50):
        out[f"sma_{k}"] = roll(c, k).mean() if n >= k else np.nan
    for k in (12, 26):
        out[f"ema_{k}"] = c.ewm(span=k, adjust=False).mean()
    out["rsi"] = rsi(c) if n >= 14 else 50.0
    out["volatility_20d"] = roll(c, 20).std() / roll(c, 20).mean() if n >= 20 else np.nan
    for k in (1, 5, 10):
        out[f"price_change_{k}d"] = (c / c.shift(k) - 1).fillna(0) if n > k else np.nan
    out["green_day"] = (c > c.shift(1)).astype(int)
    return out


def lagged(out, n_lags):
    depth = n_lags if len(out) > n_lags else max(1, len(out) - 1)
    for k in range(1, n_lags + 1):
        out[f"close_lag_{k}"] = out["close"].shift(k) if k <= depth else np.nan
    return out.iloc[depth:].copy()


def rf(g):
    out = lagged(base(g), 10)
    n, c = len(out), out["close"]
    for h in (2, 5, 10, 20, 60):
        on = n > h
        out[f"close_ratio_{h}d_ma"] = c / roll(c, h).mean() if on else np.nan
        out[f"trend_{h}d_ma"] = roll(out["green_day"].shift(1), h).sum() if on else np.nan
        out[f"momentum_{h}d"] = c / c.shift(h) - 1 if on else np.nan
    sd = roll(c, 20).std()
    out["bb_upper"], out["bb_lower"] = out["sma_20"] + 2 * sd, out["sma_20"] - 2 * sd
    out["bb_position"] = (c - out["bb_lower"]) / (4 * sd + 1e-10)
    out["macd"] = out["ema_12"] - out["ema_26"]
    out["macd_signal"] = out["macd"].ewm(span=9, adjust=False).mean()
    out["macd_histogram"] = out["macd"] - out["macd_signal"]
    return out


def xgb(g):
    out = lagged(base(g), 15)
    n, c = len(out), out["close"]
    for h in (1, 3, 5, 10, 20, 50):
        avg, hi, lo = roll(c, h).mean(), roll(c, h).max(), roll(c, h).min()
        for name, v in (("mean", c / avg), ("max", c / hi), ("min", c / lo)):
            out[f"close_to_{name}_{h}"] = v if n > h else np.nan
        out[f"range_ratio_{h}"] = (hi - lo) / avg if n > h else np.nan
    lo, hi = roll(out["low"], 14).min(), roll(out["high"], 14).max()
    out["stoch_k"] = 100 * (c - lo) / (hi - lo) if n >= 14 else np.nan
    out["williams_r"] = -100 * (hi - c) / (hi - lo) if n >= 14 else np.nan
    return out


def seq(g):
    out = base(g)
    n, c = len(out), out["close"]
    ret = (c / c.shift() - 1).fillna(0)
    out["target"] = np.log(c / c.shift()).fillna(0)
    for k in (5, 20):
        out[f"price_ma_ratio_{k}"] = c / roll(c, k).mean() if n >= k else np.nan
    for k in (5, 10, 20):
        out[f"volatility_{k}"] = roll(ret, k).std() if n >= k else np.nan
    out["bb_width"] = 4 * roll(c, 20).std() / roll(c, 20).mean() if n >= 20 else np.nan
    tr = pd.concat([out["high"] - out["low"], (out["high"] - c.shift()).abs(), (out["low"] - c.shift()).abs()],
                   axis=1).max(axis=1)
    out["atr_14"] = tr.ewm(alpha=1 / 14, adjust=False).mean()
    return lagged(out, 5)


@pytest.mark.parametrize("name,formula", [("rf", rf), ("xgb", xgb), ("lstm", seq)])
def test_recipe(bars, name, formula):
    df, pdf = bars
    got = R.recipe(name).build(df).toPandas().sort_values(["ticker", "ds"]).reset_index(drop=True)
    parts = [formula(g.reset_index(drop=True)) for _, g in pdf.groupby("ticker") if len(g) > 1]
    want = pd.concat(parts, ignore_index=True)
    assert list(got["ticker"]) == list(want["ticker"])
    assert list(got["ds"]) == list(want["ds"])
    for c in want.columns.difference(["ticker", "ds", "close"] if name == "lstm" else ["ticker", "ds"]):
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-8, atol=1e-7, err_msg=c)


def test_base_fills_the_first_row(bars):
    df, pdf = bars
    got = R.features_base(df).where("ticker = 'G300'").orderBy("ds").toPandas()
    assert got["volatility_20d"].notna().all()
    assert got["volatility_20d"][0] == got["volatility_20d"][1]


def test_infinite_ratios_are_dropped(spark, bars):
    df, _ = bars
    series = df.where("ticker = 'G300'")
    zero = series.withColumn("close", F.when(F.col("ds") == "2020-06-01", 0.0).otherwise(F.col("close")))
    kept = R.features_seq(zero)
    days = {str(r["ds"]) for r in kept.where("ds BETWEEN '2020-05-29' AND '2020-06-03'").select("ds").collect()}
    assert "2020-06-01" not in days and "2020-06-02" not in days and "2020-05-29" in days


def test_constant_price(spark):
    days = pd.bdate_range("2020-01-01", periods=90).date
    pdf = pd.DataFrame({"ticker": "K", "ds": days, "open": 5.0, "high": 5.0, "low": 5.0, "close": 5.0, "volume": 1.0})
    row = R.features_rf(spark.createDataFrame(
        pdf, "ticker string, ds date, open double, high double, low double, close double, volume double"))
    last = row.orderBy(F.desc("ds")).first()
    assert last["rsi"] == 0.0 and last["macd"] == pytest.approx(0) and last["bb_position"] == pytest.approx(0)


def test_unknown_names():
    with pytest.raises(ValueError, match="unknown model type"):
        R.recipe("arima")
    assert R.recipe("Random_Forest") is R.RF


def test_missing_column(bars):
    df, _ = bars
    with pytest.raises(ValueError, match="close"):
        R.features_rf(df.drop("close"))
